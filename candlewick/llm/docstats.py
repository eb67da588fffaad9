"""Statistics of whole texts, and the bounded labelled sample that classifiers are fitted on.

Statistics come from one pass over the text's UTF-8 bytes in numpy; ids, language, source
and labels are never inputs. Null and empty texts have zero for everything.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import map_documents

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "shouts", "pipes",
    "distinct_words", "line_words", "stops", "commas", "non_ascii", "longest_word", "other_punct",
)
#: Rows that a classifier is fitted on at most; labelled rows beyond are left out by hash order.
MAX_LABELLED = 20_000


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars]] = True
    return m


def repeated_words(words: list) -> int:
    """Words that stand in a window of five words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    size = n - WINDOW + 1
    mixed = h[:size].copy()
    for k in range(1, WINDOW):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : k + size]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    often = np.zeros(size, dtype=bool)  # windows whose hash is found again; equal windows are counted exactly
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often).tolist()
    found = Counter(tuple(words[i : i + WINDOW]) for i in at)
    covered = np.zeros(n + 1, dtype=np.int64)
    for i in at:
        if found[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


class Statistics:
    """Text to (counts, features)."""

    def __init__(self) -> None:
        self.space, self.symbols = _mask(" \t\n\x0b\x0c\r"), _mask(SYMBOLS)
        self.upper = _mask("".join(map(chr, range(65, 91))))
        self.digits = _mask("0123456789")
        self.punct = _mask("\"'()-/:;=?@[]\\^_`{}~+")

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        raw = text.encode()
        words = raw.split()  # bytes split on ASCII white space only
        n = len(words)
        if not n:
            return [0] * len(COUNTS), [0.0] * len(FEATURES)
        by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        word_chars = len(text) - int(by[self.space].sum())
        n_symbols = int(by[self.symbols].sum())
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n_dup = len(lines) - len(set(lines))
        n_repeat = repeated_words(words)
        chars = max(1, word_chars)
        features = [
            float(np.log1p(n)), word_chars / n, n_symbols / chars, n_dup / len(lines), n_repeat / n,
            int(by[self.upper].sum()) / chars, int(by[self.digits].sum()) / chars, int(by[33]) / n, int(by[124]) / n,
            len(set(words)) / n, n / len(lines), int(by[46]) / n, int(by[44]) / n, int(by[128:].sum()) / len(raw),
            float(np.log1p(max(map(len, words)))), int(by[self.punct].sum()) / chars,
        ]
        return [n, word_chars, n_symbols, n_dup, n_repeat], features


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` documents that are not held out, the first by hash.

    A document with several labels takes their mean, at least a half being 1; a doc_id with
    several texts takes the smallest features.
    """
    one = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = one.groupBy(F.col("doc_id").cast("long").alias("id_")).agg((F.avg(label) >= 0.5).cast("int").alias("y_"))
    one = one.orderBy(F.xxhash64("id_"), "id_").limit(limit)
    # at most ``limit`` narrow rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(one), F.col("doc_id") == F.col("id_"))

    def factory():
        of = Statistics()

        def apply(doc_id, texts, y):
            return {"doc_id": doc_id, "x": [of(t)[1] for t in texts], "y": y}

        return apply

    found = map_documents(rows.select("doc_id", "text", "y_"), "doc_id long, x array<double>, y int", factory)
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return x, np.array([r.y for r in rows], dtype=float)
