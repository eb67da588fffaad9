"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its words; its k-mers are runs of five words, labelled with their occurrence
number in the text. An order-MinHash sample takes, under one hash order, the three labelled
k-mers that come first and keeps them in text order, so two texts agree on it with a
probability that falls with their edit similarity, not just their sets. Two samples make a
band, 36 bands a sketch: texts of more than 30 k-mers with a k-mer similarity of 0.8 share a
band with a probability above 0.9999, of 0.3 with one below 0.03. The fewer k-mers, the
lower it is (4 common of 5: 0.998), so shorter texts do not depend on it.

1. Texts with equal words are one node, the smallest doc_id of theirs.
2. In every bucket (nodes with an equal band) all nodes are compared with the hub, the node
   that meets most others over all its buckets. Links are pairs with a set similarity of
   five-word k-mers of 0.8 or more and a word-level edit similarity of 0.8 or more by a
   banded alignment.
3. Links make components. A bucket whose nodes lie in one component can't change
   anything. In the others, nodes outside the hub's component are compared with those of
   other components that can reach the set similarity: of each node's k-mers, rarest
   first, only so many are indexed that two similar nodes must share one of them, at a
   place that leaves enough k-mers to agree on (prefix and position filters, both exact).
   Texts of at most 30 k-mers are all compared like this, whatever their buckets. Two short
   texts meet by k-mer and both sizes; where too many would meet, by their first two
   common k-mers, then three and so on, until few meet or all they need is common. No partner
   is capped, and no bucket is paired off as a whole.
4. Components again, over all links. A class is named by its smallest doc_id.

Large groups: copies are collapsed by an aggregate with partial sums; buckets are only
aggregated and joined on their band; comparisons are rows of their own.

Edge cases: null and empty texts have no words and are one class; texts of fewer than five
words are one k-mer; rows with equal doc_id are one document, whose class holds all its
texts; rows with a null doc_id have a null class; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import few, map_documents, written
from candlewick.llm.components import components

K, PICKED, SAMPLES_PER_BAND, BANDS = 5, 3, 2, 36
SIMILAR = 0.8
#: Words of texts (30 k-mers) that do not depend on their sketches, and of the longest that can be similar to them.
SHORT = 34
SHORT_PARTNER = int(SHORT / SIMILAR + 1e-9) + 1
#: Short texts that meet by the same k-mers are told apart by one more if they make more pairs than this a text.
PAIRS_PER_ROW = 32
SEED = 20_240
#: Kept words per task; beyond, the table is emptied and grows anew.
MAX_WORDS = 150_000


class WordHash(dict):
    """Word to 64 bits, the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out = mixed(out) + words[i : n - k + 1 + i]
    return mixed(out)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence number mixed in."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if first.all():
        return mixed(grams)
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), dtype=np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mixed(grams + occurrence * np.uint64(0xD1B54A32D192ED03))


class Sketch:
    """Words to 36 band values."""

    def __init__(self, bands: int = BANDS, samples: int = SAMPLES_PER_BAND, picked: int = PICKED):
        random = np.random.default_rng(SEED)
        self.bands, self.samples, self.picked = bands, samples, picked
        n = bands * samples
        self.xor = random.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.times = (random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.salt = random.integers(0, 1 << 63, bands, dtype=np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        x = labelled(kmers(words))
        n, total = len(x), len(self.xor)
        if not n:
            return np.zeros(0, dtype=np.int64)
        take = min(self.picked, n)
        step = max(1, (1 << 19) // n)
        samples = []
        for at in range(0, total, step):
            order = (x[None, :] ^ self.xor[at : at + step]) * self.times[at : at + step]
            order ^= order >> np.uint64(32)
            first = np.argpartition(order, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(order), 1))
            first.sort(axis=1)  # the picked ones in text order
            value = np.zeros(len(first), dtype=np.uint64)
            for c in range(take):
                value = mixed(value) + x[first[:, c]]
            samples.append(value)
        values = np.concatenate(samples).reshape(self.bands, self.samples)
        out = self.salt.copy()
        for c in range(self.samples):
            out = mixed(out) + values[:, c]
        return mixed(out).view(np.int64)


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common k-mers among all of two texts, as sets."""
    x, y = np.unique(kmers(a)), np.unique(kmers(b))
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences if at most ``limit``, else ``limit`` + 1.

    For each number of edits, the furthest position on each diagonal of the band; runs of equal
    words on a diagonal are passed in one step, by the list of its differences.
    """
    n, m = len(a), len(b)
    short = min(n, m)
    if short:  # equal ends cost nothing
        differs = np.flatnonzero(a[:short] != b[:short])
        head = int(differs[0]) if len(differs) else short
        a, b = a[head:], b[head:]
        short = min(len(a), len(b))
        if short:
            differs = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
            tail = int(differs[0]) if len(differs) else short
            a, b = a[: len(a) - tail], b[: len(b) - tail]
        n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    if not n or not m:
        return max(n, m)
    differences: dict[int, np.ndarray] = {}

    def passed(i: int, d: int) -> int:
        """First row from i on that differs on diagonal d (column = row + d), or the diagonal's end."""
        found = differences.get(d)
        if found is None:
            lo, hi = max(0, -d), min(n, m - d)
            found = differences[d] = np.append(np.flatnonzero(a[lo:hi] != b[lo + d : hi + d]) + lo, hi)
        return int(found[np.searchsorted(found, i)]) if i < found[-1] else i

    goal = m - n
    reach = {0: passed(0, 0)}
    for edits in range(limit + 1):
        if reach.get(goal, -1) >= n:
            return edits
        following = {}
        # diagonals from which the goal can still be reached within the limit
        for d in range(max(-edits - 1, goal - (limit - edits - 1), -n), min(edits + 1, goal + (limit - edits - 1), m) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            i = min(i, n, m - d)
            if i >= max(0, -d):
                following[d] = passed(i, d)
        reach = following
    return limit + 1


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> tuple[float, bool]:
    """Set similarity of two texts' k-mers, and whether both it and the edit similarity suffice."""
    share = set_similarity(a, b)
    if share < least:
        return share, False
    longest = max(len(a), len(b))
    limit = int((1 - least) * longest + 1e-9)
    return share, longest == 0 or banded_distance(a, b, limit) <= limit


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the words), n (number of words), bands."""

    def factory():
        words_of, sketch = WordHash(), Sketch()

        def apply(doc_id, texts):
            keys, counts, bands = [], [], []
            for t in texts:
                words = (t or "").encode().split()
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(len(words))
                bands.append(sketch(words_of.array(words)))
            return {"doc_id": doc_id, "key": keys, "n": counts, "bands": bands}

        return apply

    return map_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), "doc_id long, key binary, n long, bands array<long>", factory, step=128)


def word_rows(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """node, key and w (its words as 64-bit hashes) of the wanted nodes' texts."""

    def factory():
        words_of = WordHash()

        def apply(doc_id, texts):
            words = [(t or "").encode().split() for t in texts]
            keys = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            return {"node": doc_id, "key": keys, "w": [words_of.array(w).astype("<u8").tobytes() for w in words]}

        return apply

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), text).join(few(nodes.select("node")), "node")
    return map_documents(rows.select("node", text), "node long, key binary, w binary", factory, step=128)


def compared(pairs: DataFrame, words: DataFrame, least: float = SIMILAR) -> DataFrame:
    """pairs (a, b) with share and linked."""

    def factory():
        def apply(a, b, x, y):
            found = [alike(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), least) for p, q in zip(x, y)]
            return {"a": a, "b": b, "share": [f[0] for f in found], "linked": [f[1] for f in found]}

        return apply

    both = pairs.join(words.select(F.col("node").alias("a"), F.col("w").alias("x")), "a")
    both = both.join(words.select(F.col("node").alias("b"), F.col("w").alias("y")), "b")
    return map_documents(both.select("a", "b", "x", "y"), "a long, b long, share double, linked boolean", factory, step=128)


def hubs(placed: DataFrame) -> DataFrame:
    """bucket, node and hub for every node of a bucket with two nodes or more. ``placed``: node, bucket."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = written(placed.join(sizes, "bucket"), "members")
    meets = member.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = member.join(meets, "node").select("bucket", "meets", (-F.col("node")).alias("minus"))
    hub = ranked.groupBy("bucket").agg((-F.max(F.struct("meets", "minus"))["minus"]).alias("hub"))
    return member.select("bucket", "node").join(hub, "bucket")


def gram_rows(words: DataFrame) -> DataFrame:
    """node and g: each of its different k-mers."""

    def factory():
        def apply(node, w):
            return {"node": node, "grams": [np.unique(kmers(np.frombuffer(x, "<u8"))).view(np.int64) for x in w]}

        return apply

    return map_documents(words.select("node", "w"), "node long, grams array<long>", factory, step=128).select("node", F.explode("grams").alias("g"))


def cross_pairs(side: DataFrame, words: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b), a > b, of different components that may reach the set similarity, one of them outside.

    ``side``: node, root, outside. Two sets of sizes m and n with a similarity of t have at least
    t / (1 + t) * (m + n) members in common; with all members in one order, the first common
    one has that many left from its place on in both.
    """
    grams = written(gram_rows(words.join(side.select("node"), "node")), "grams")
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    ordered = grams.join(often, "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("all"))
    alone = F.size(F.filter("all", lambda e: e["n"] == 1))  # first, and met by no other text
    ordered = ordered.select("node", F.size("all").alias("size"), alone.alias("alone"), F.col("all.g").alias("all")).join(side, "node")
    ordered = written(ordered, "ordered")
    long_pairs = _long_pairs(ordered, least)
    return long_pairs.union(_short_pairs(ordered.where(F.col("size") <= SHORT_PARTNER), least)).distinct()


def _common(size: Column, other: Column, least: float) -> Column:
    """Members that sets of these sizes must have in common."""
    return F.ceil(least / (1 + least) * (size + other) - 1e-9).cast("int")


def _pair() -> list[Column]:
    return [F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b")]


def _apart() -> Column:
    return (F.col("root") != F.col("root_")) & (F.col("outside") | F.col("outside_"))


def _long_pairs(ordered: DataFrame, least: float) -> DataFrame:
    """Pairs of which one has more than SHORT_PARTNER k-mers."""
    first = F.slice("all", F.lit(1), (F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1).cast("int"))
    prefix = ordered.where(F.col("size") > int(least * SHORT_PARTNER))
    prefix = prefix.select("node", "size", "root", "outside", "alone", F.posexplode(first).alias("at", "g"))
    prefix = written(prefix.where("at >= alone").drop("alone"), "prefixes")
    # of two different components one is not the k-mer's most frequent: a large one never meets itself
    parts = prefix.groupBy("g", "root").agg(F.count("*").alias("n"), F.max("size").alias("size")).groupBy("g").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"), F.max("size").alias("most"))
    parts = parts.where((F.col("parts") > 1) & (F.col("most") > SHORT_PARTNER))
    prefix = written(prefix.join(parts.select("g", "main"), "g"), "met")
    other = prefix.select(*[F.col(c).alias(f"{c}_") for c in prefix.columns])
    common = _common(F.col("size"), F.col("size_"), least)
    enough = (F.col("at") <= F.col("size") - common) & (F.col("at_") <= F.col("size_") - common)
    long = F.greatest("size", "size_") > SHORT_PARTNER
    return prefix.where("root <> main").join(other, (F.col("g") == F.col("g_")) & _apart() & enough & long).select(*_pair())


def _short_pairs(ordered: DataFrame, least: float) -> DataFrame:
    """Pairs of at most SHORT_PARTNER k-mers each.

    A row is a text that looks for, or is, a partner of one size (``lo`` and ``hi`` are both sizes), with
    the places of its first so many k-mers in common with such a partner hashed in ``h``. Pairs
    agree on ``h``, ``lo`` and ``hi``. Where those are too many, each row becomes one for every
    place that its next common k-mer may have: so few may be missed in between that they are
    bounded by the sizes alone, and all rows are split alike in parallel.
    """
    size = F.col("size")
    partners = F.sequence(F.ceil(least * size - 1e-9).cast("int"), F.least(F.floor(size / least + 1e-9).cast("int"), F.lit(SHORT_PARTNER)))
    rows = ordered.withColumn("want", F.explode(partners)).withColumn("common", _common(size, F.col("want"), least))
    rows = rows.where(F.col("alone") <= size - F.col("common"))
    rows = rows.select("node", "root", "outside", "size", "want", "common", F.least("size", "want").alias("lo"), F.greatest("size", "want").alias("hi"),
                       F.explode(F.sequence("alone", size - F.col("common"))).alias("at"))
    lists = ordered.select("node", "all")

    def hashed(rows: DataFrame, *before: str) -> DataFrame:
        named = rows.join(lists, "node").withColumn("h", F.xxhash64(*before, F.element_at("all", F.col("at") + 1)))
        return named.drop("all")

    key, kept = ["h", "lo", "hi"], ["node", "root", "outside", "size", "want", "common", "lo", "hi", "at", "h"]
    rows, depth, found = hashed(rows), 1, None
    while True:
        rows = written(rows.select(*kept), "short")
        small, large = F.col("size") == F.col("lo"), F.col("size") == F.col("hi")
        of_root = rows.groupBy(*key, "root").agg(
            F.count("*").alias("n"), F.count_if(small).alias("s"), F.count_if(large).alias("l"), F.max("outside").alias("outside"))
        groups = of_root.groupBy(*key).agg(
            F.max(F.struct("n", "root", "s", "l")).alias("m"), F.sum("s").alias("s"), F.sum("l").alias("l"),
            F.count("*").alias("parts"), F.max("outside").alias("open"))
        groups = groups.where((F.col("parts") > 1) & F.col("open") & (F.col("s") > 0) & (F.col("l") > 0))
        pairs = (F.col("s") - F.col("m.s")) * F.col("l") + (F.col("l") - F.col("m.l")) * F.col("s")
        groups = groups.select(*key, F.col("m.root").alias("main"), (pairs > PAIRS_PER_ROW * (F.col("s") + F.col("l"))).alias("hot"))
        met = written(rows.join(groups, key).withColumn("hot", F.col("hot") & (F.col("common") > depth)), "short-met")
        cold = met.where(~F.col("hot"))
        other = cold.select(*[F.col(c).alias(f"{c}_") for c in (*key, "node", "root", "outside", "size")])
        same = [F.col(c) == F.col(f"{c}_") for c in key]
        now = cold.where("root <> main").join(other, [*same, F.col("want") == F.col("size_"), _apart()]).select(*_pair())
        found = now if found is None else found.union(now)
        hot = met.where("hot")
        if hot.isEmpty():
            return found
        following = F.sequence(F.col("at") + 1, F.col("size") - F.col("common") + F.lit(depth))
        rows, depth = hashed(hot.withColumn("at", F.explode(following)).withColumnRenamed("h", "before"), "before"), depth + 1


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, node (smallest doc_id with equal words) and class_id for every row of ``docs``."""
    sketched = written(sketches(docs, text), "sketches")
    nodes = written(sketched.groupBy("key").agg(F.min("doc_id").alias("node")), "nodes")
    # one row per text: of rows with the node's id, those with its words
    bands = sketched.select("doc_id", "key", "n", "bands").join(nodes, "key").where("doc_id = node").select("node", "key", "n", "bands").dropDuplicates(["node", "key"])
    short = bands.where(F.col("n").between(1, SHORT_PARTNER)).groupBy("node").agg((F.min("n") <= SHORT).alias("outside"))
    short = written(short, "short")
    members = written(hubs(bands.select("node", F.explode("bands").alias("bucket")).distinct()), "hubs")
    pairs = members.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(short.select("node")).distinct(), "wanted")
    words = word_rows(docs, wanted, text).join(nodes.select("key", F.col("node").alias("of")), "key").where("node = of")
    words = written(words.select("node", "key", "w").dropDuplicates(["node", "key"]).select("node", "w"), "words")
    compared_first = written(compared(pairs, words), "compared")
    roots = components(compared_first.where("linked").select("a", "b"))

    found = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    found = found.join(hub_root, "hub", "left").withColumn("outside", F.col("root") != F.coalesce("hub_root", "hub"))
    found = written(found.select("bucket", "node", "root", "outside"), "rooted")
    open_buckets = found.where("outside").select("bucket").distinct()
    side = found.join(open_buckets, "bucket").select("node", "root", "outside")
    side = side.unionByName(short.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "outside"))
    side = side.groupBy("node", "root").agg(F.max("outside").alias("outside"))
    more = cross_pairs(written(side, "open"), words)
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "cross")
    more = written(compared(more, words), "compared")
    links = compared_first.where("linked").select("a", "b").unionByName(more.where("linked").select("a", "b"))
    return named(sketched, nodes, links)


def named(sketched: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, node and class_id of every row, from the links between nodes.

    A doc_id with several texts ties their nodes together.
    """
    rows = sketched.select("doc_id", "key").join(nodes, "key").select("doc_id", "node")
    several = rows.distinct().groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    tied = rows.distinct().join(several.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")
    roots = components(links.unionByName(tied))
    return rows.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("class_id"))
