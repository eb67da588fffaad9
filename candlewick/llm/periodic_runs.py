"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a stretch of words with smallest period q (words q apart are identical) that no
neighbouring word extends, at least ``MIN_POWER`` periods and ``MIN_WORDS`` words long.

* Ukkonen's algorithm builds the suffix tree of a document's words and that of their reversal.
  The Euler tour of a tree's string depths, with range minima, gives the depth of the lowest
  common ancestor of two leaves, the longest common extension of two places (forwards by the
  first tree, backwards by the second), in constant time each.
* Candidates are Lyndon roots: from each place the longest Lyndon word, which ends where the
  next smaller suffix begins, for the order of words and for its reverse; suffix ranks come
  from the first tree's leaves. Every run has such a root, and the root's length is its
  smallest period, so both extensions of a candidate give the run whole.

Before that, words which can't be in a run are set apart, which is exact: a word of a run is
found at least ``MIN_POWER`` times in it, so rarer words of a stretch cut it. The stretches of
several documents share a pair of trees; a cut is a symbol of its own, so nothing extends
across it. All places of a batch are extended at once in numpy.

Edge cases: null and text without words have no words, no runs, and the digest of the empty
text; repeated rows give repeated results; null doc_ids are kept; further columns are ignored;
an empty table gives an empty result. The largest thing a task holds is one document with the
two trees of its stretches, about 400 bytes a word that is left in them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import WORD, map_documents

MIN_POWER, MIN_WORDS = 4, 6
#: Words from which on a pair of trees is built; a longer stretch has a pair of its own.
TREE_WORDS = 1 << 15
#: Rounds of cutting stretches at rare words; what is left then is searched as it is.
ROUNDS = 6


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols below ``n_symbols``, the last one found once.

    ``parents``, ``symbols``, ``nodes``: every edge, ordered by parent and first symbol. The
    root is 0; leaves are ``leaf`` + i for the suffix from i on; ``depth`` is string depth.
    """

    def __init__(self, text: list[int], n_symbols: int):
        n = len(text)
        # internal nodes count from 0, the leaf of suffix i is n + i
        begin, end, link, depth = [0] * (2 * n), [n] * (2 * n), [0] * n, [0] * n
        go: dict[int, int] = {}
        get = go.get
        count, node, edge, along, suffix = 1, 0, 0, 0, 0
        for i, symbol in enumerate(text):
            waits = 0  # the internal node whose suffix link is still to be set
            while suffix <= i:
                if not along:
                    edge = i
                key = node * n_symbols + text[edge]
                child = get(key)
                if child is None:
                    begin[n + suffix] = i
                    go[key] = n + suffix
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    at = begin[child]
                    if child < n and along >= end[child] - at:
                        along -= end[child] - at
                        edge += end[child] - at
                        node = child
                        continue
                    if text[at + along] == symbol:
                        along += 1
                        if waits:
                            link[waits] = node
                        break
                    begin[count], end[count], depth[count] = at, at + along, i - suffix
                    go[key] = count
                    begin[child] = at + along
                    go[count * n_symbols + text[at + along]] = child
                    begin[n + suffix] = i
                    go[count * n_symbols + symbol] = n + suffix
                    if waits:
                        link[waits] = count
                    waits = count
                    count += 1
                suffix += 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = suffix
        self.n, self.leaf, self.n_symbols = n, n, n_symbols
        keys = np.fromiter(go.keys(), dtype=np.int64, count=len(go))
        order = np.argsort(keys)
        self.nodes = np.fromiter(go.values(), dtype=np.int64, count=len(go))[order]
        self.parents, self.symbols = np.divmod(keys[order], n_symbols)
        self.depth = np.concatenate([np.array(depth, dtype=np.int32), np.arange(n, 0, -1, dtype=np.int32)])

    def tour(self) -> np.ndarray:
        """Euler tour in the order of symbols: nodes as they are entered, and ~parent between two children."""
        k = len(self.nodes)
        # per parent, last child first: c_k, ~p, c_(k-1), ~p, ..., c_1, as a stack takes them
        steps = np.empty(2 * k, dtype=np.int64)
        steps[0::2], steps[1::2] = self.nodes[::-1], ~self.parents[::-1]
        return np.array(self._walk(steps.tolist(), self.parents[::-1], 2), dtype=np.int64)

    def ranks(self, cuts: int) -> np.ndarray:
        """Suffix ranks for the reverse order of symbols; those below ``cuts`` stay the smallest."""
        by = np.lexsort((np.where(self.symbols < cuts, -self.symbols, self.symbols), self.symbols >= cuts, self.parents))
        # cuts come last on the stack, so they are entered first
        flip = np.lexsort((np.arange(len(by)), self.symbols[by] < cuts, self.parents[by]))
        order = by[flip]
        walk = np.array(self._walk(self.nodes[order].tolist(), self.parents[order], 1), dtype=np.int64)
        out = np.empty(self.n, dtype=np.int64)
        out[walk[walk >= self.leaf] - self.leaf] = np.arange(self.n)
        return out

    def _walk(self, steps: list[int], parents: np.ndarray, width: int) -> list[int]:
        """Depth-first: ``steps`` holds, parent by parent, what goes on the stack."""
        n, out, stack = self.n, [], [0]
        first = np.full(n, -1, dtype=np.int64)
        change = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        first[parents[change]] = change
        size = np.zeros(n, dtype=np.int64)
        size[parents[change]] = np.diff(np.append(change, len(parents)))
        starts = (first * width).tolist()
        # with returns between children, the one after the last child is left out
        stops = ((first + size) * width - (width - 1)).tolist()
        pop, push, add = stack.pop, stack.extend, out.append
        while stack:
            v = pop()
            add(v)
            if 0 <= v < n:
                push(steps[starts[v] : stops[v]])
        return out


class Extensions:
    """Longest common extensions of places in a text: lowest common ancestors by range minima over the tour."""

    def __init__(self, tree: SuffixTree):
        tour = tree.tour()
        self.depths = tree.depth[np.where(tour < 0, ~tour, tour)]
        self.entered = np.empty(tree.n, dtype=np.int64)
        leaves = np.flatnonzero(tour >= tree.leaf)
        self.entered[tour[leaves] - tree.leaf] = leaves
        self.ranks = np.empty(tree.n, dtype=np.int64)
        self.ranks[tour[leaves] - tree.leaf] = np.arange(len(leaves))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Depth of the lowest common ancestor of the leaves of each pair of different places."""
        x, y = self.entered[a], self.entered[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(float))[1] - 1  # floor of the binary logarithm
        out, table, width = np.zeros(len(a), dtype=np.int64), self.depths, 1
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2))
        for k in range(len(bounds) - 1):  # a level of the sparse table at a time
            some = order[bounds[k] : bounds[k + 1]]
            out[some] = np.minimum(table[low[some]], table[high[some] - width + 1])
            table = np.minimum(table[: len(table) - width], table[width:]) if len(table) > width else table
            width *= 2
        return out


def next_smaller(ranks: list[int]) -> list[int]:
    """Per place the next one of a smaller rank; the last place stands for itself."""
    n = len(ranks)
    out, stack = [n - 1] * n, []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of_symbols(text: list[int], cuts: int, n_symbols: int, power: int = MIN_POWER, least: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period) of a text that begins and ends with a cut; cuts (symbols below ``cuts``) are found once each."""
    n = len(text)
    tree = SuffixTree(text, n_symbols)
    forward = Extensions(tree)
    ranks = (forward.ranks, tree.ranks(cuts))
    del tree
    i = np.arange(n - 1, dtype=np.int64)
    i = i[np.array(text[:-1]) >= cuts]
    pairs = np.unique(np.concatenate([np.stack([i, np.array(next_smaller(r.tolist()), dtype=np.int64)[i]], axis=1) for r in ranks]), axis=0)
    i, j = pairs[:, 0], pairs[:, 1]
    right = forward.of(i, j)
    del forward
    backward = Extensions(SuffixTree(text[::-1], n_symbols))
    left = backward.of(n - i, n - j)  # what ends before both
    period, length = j - i, j - i + left + right
    keep = length >= np.maximum(least, power * period)
    return np.unique(np.stack([i - left, length, period], axis=1)[keep], axis=0).reshape(-1, 3)


def stretches(words: Sequence, power: int = MIN_POWER, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first, end) of the parts of ``words`` that may hold runs: words found less than ``power`` times in a part cut it."""
    todo, out = [(0, len(words))], []
    for turn in range(ROUNDS):
        parts = []
        for a, b in todo:
            if b - a < least:
                continue
            part = words[a:b]
            times = Counter(part)
            rare = {w for w, c in times.items() if c < power}
            if not rare:
                out.append((a, b))
                continue
            at = a
            for k, w in enumerate(part, a):
                if w in rare:
                    if k - at >= least:
                        parts.append((at, k))
                    at = k + 1
            if b - at >= least:
                parts.append((at, b))
        todo = parts
    return sorted(out + todo)


def runs_of_documents(documents: Iterable[Sequence], power: int = MIN_POWER, least: int = MIN_WORDS) -> Iterator[list[tuple[int, int, int]]]:
    """Per document (a list of words) its runs (start, length, period) by start, then period."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    batch: list[tuple[int, int, Sequence]] = []
    size = done = count = 0

    def search() -> None:
        ids: dict = {}
        cuts = len(batch) + 1
        text, place = [0], [(0, 0)]  # where each stretch begins in the text, its document and first word
        for k, (d, a, part) in enumerate(batch):
            place.append((len(text), k))
            text.extend(ids.setdefault(w, cuts + len(ids)) for w in part)
            text.append(k + 1)
        rows = runs_of_symbols(text, cuts, cuts + len(ids), power, least)
        starts = np.array([p for p, _ in place[1:]], dtype=np.int64)
        for k, (s, length, q) in zip((np.searchsorted(starts, rows[:, 0], side="right") - 1).tolist(), rows.tolist()):
            d, a, _ = batch[k]
            found.setdefault(d, []).append((a + s - int(starts[k]), length, q))
        batch.clear()

    for d, words in enumerate(documents):
        count = d + 1
        for a, b in stretches(words, power, least):
            batch.append((d, a, words[a:b]))
            size += b - a
        if size >= TREE_WORDS:
            search()
            size = 0
            for k in range(done, count):
                yield sorted(found.pop(k, ()), key=lambda r: (r[0], r[2]))
            done = count
    if batch:
        search()
    for k in range(done, count):
        yield sorted(found.pop(k, ()), key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence, runs: Iterable[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    drop = [(s + q, s + length) for s, length, q in runs]
    if not drop:
        return list(words)
    out, at = [], 0
    for a, b in sorted(drop):
        if a > at:
            out.extend(words[at:a])
        at = max(at, b)
    out.extend(words[at:])
    return out


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", power: int = MIN_POWER, least: int = MIN_WORDS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``,
    the text's words without repetitions, joined by a space."""

    def factory():
        def apply(doc_ids, texts):
            words = [(t or "").encode().split() for t in texts]  # bytes split on ASCII white space only
            runs = list(runs_of_documents(words, power, least))
            return {
                "doc_id": doc_ids, "n_words": [len(w) for w in words],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                "collapsed": [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)],
            }

        return apply

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_documents(rows, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", factory)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The query's text: of ids whose crc32 ends in 0, the words from one on repeat the first few from there."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    parts = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda x: F.struct(x.w.alias("w"), x.g.alias("g"), (x.g % F.size(x.w)).alias("a")))
    parts = F.transform(parts, lambda x: F.struct(x.w.alias("w"), x.a.alias("a"), (1 + F.floor((F.size(x.w) - x.a) / (3 + x.g % 8))).cast("long").alias("p")))

    def again(x):
        return F.transform(x.w, lambda w, i: F.when(i < x.a, w).otherwise(F.get(x.w, (x.a + (i - x.a) % x.p).cast("int"))))

    out = F.array_join(F.element_at(F.transform(parts, again), 1), " ")
    return F.when((h % 10 == 0) & F.col(text).rlike(WORD), out).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length / period, and digests of all runs and of the collapsed text."""
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda a, b: F.when(b.length * a.period > a.length * b.period, b).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
