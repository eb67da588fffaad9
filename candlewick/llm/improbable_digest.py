"""Document fingerprints of improbable features, kept in chained Bloom filters.

* Every window of 64 bytes has an entropy, in thousandths of the most it can have. Windows are
  ranked by how rare their entropy is among all windows of all documents (``rarity``, a table
  of 1,001 counts); windows of nearly one byte only come last, they say little.
* In every stretch of 64 neighbouring windows the rarest one wins, the first if equal. Windows
  that win in at least 16 stretches are the text's features; equal ones count once.
* A feature's hash sets 5 of the 2,048 bits of a Bloom filter. A filter takes 160 features,
  then the next one in the chain begins.
* Two filters are compared by the bits they share beyond what chance gives, over the most that
  they could share beyond that. Two fingerprints: the best match of each filter of the one
  with fewer, weighted by its features; of both ways the mean if they have equally many.

Entropies are running sums of integers over numpy arrays, so a window has the same rank in any
text. Long texts are taken in pieces that overlap by what a stretch reaches.

Edge cases: a text of less than 64 bytes is one window, filled up with zero bytes; null and
empty texts have no features, the fingerprint ``0:``, and are alike (1.0) among themselves only;
rows of equal doc_id follow one another by the hash of their text, null doc_ids come last; a
single document is its own next one; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candlewick.llm.common import map_documents, release_memory

WINDOW, STRETCH, WINS = 64, 64, 16
FILTER_BITS, FILTER_FEATURES, HASHES, HASH_BITS = 2048, 160, 5, 11
LEVELS = 1001
#: Entropies (in thousandths) below which a window comes after all others.
LOW = 100
#: Window places of a piece, and bytes taken at once; places fit the 21 bits that a key leaves them.
PIECE, BATCH, PLACE_BITS = 1 << 18, 1 << 19, 21
#: Bytes of text per range of the order of documents, and ranges at most.
RANGE_BYTES, MAX_RANGES = 16 << 20, 20_000

_counts = np.arange(WINDOW + 1)
#: c * log2(c) in units of 2^-20, and what one more of c equal bytes adds.
_WEIGHT = np.rint(_counts * np.log2(np.maximum(_counts, 1)) * (1 << 20)).astype(np.int64)
_MORE = np.diff(_WEIGHT)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level (0 to 1000) of every window of a byte array that begins with ``WINDOW`` zero bytes."""
    n = len(raw)
    back, ahead = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    step = 1 << 16  # stays in the processor's cache
    for a in range(0, n, step):
        b = min(n, a + step)
        for lag in range(1, WINDOW):
            low = max(a, lag)
            if low < b:
                same = raw[low:b] == raw[low - lag : b - lag]
                back[low:b] += same
                ahead[low - lag : b - lag] += same
    change = _MORE[back[WINDOW:]] - _MORE[ahead[: n - WINDOW]]
    sums = np.empty(n - WINDOW + 1, dtype=np.int64)
    sums[0] = 0
    np.cumsum(change, out=sums[1:])
    # the first window is all zeros: the sum is at its most, the entropy at its least
    return (-LEVELS + 1) * sums // _WEIGHT[WINDOW]


def _batches(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of many texts with zeros between, and per place of a window: whether it is one, whether it counts here, whose."""
    parts: list[tuple[int, bytes, int, int, int]] = []
    size = 0

    def joined():
        total = WINDOW + sum(len(p) + 2 * WINDOW for _, p, *_ in parts)
        raw = np.zeros(total, dtype=np.uint8)
        valid, kept = np.zeros(total - WINDOW + 1, dtype=bool), np.zeros(total - WINDOW + 1, dtype=bool)
        owner, at = np.zeros(total - WINDOW + 1, dtype=np.int32), WINDOW
        for d, p, windows, first, end in parts:
            raw[at : at + len(p)] = np.frombuffer(p, dtype=np.uint8)
            valid[at : at + windows] = True
            kept[at + first : at + end] = True
            owner[at : at + windows] = d
            at += len(p) + 2 * WINDOW
        return raw, valid, kept, owner

    reach = STRETCH - 1
    for d, text in enumerate(texts):
        windows = max(1, len(text) - WINDOW + 1) if text else 0
        for a in range(0, windows, PIECE):
            b = min(windows, a + PIECE)
            low, high = max(0, a - reach), min(windows, b + reach)
            part = text[low : high + WINDOW - 1]
            parts.append((d, part, high - low, a - low, b - low))
            size += len(part) + 2 * WINDOW
            if size >= BATCH:
                yield joined()
                parts.clear()
                size = 0
    if parts:
        yield joined()


def level_counts(texts: Sequence[bytes]) -> np.ndarray:
    """Windows per entropy level."""
    out = np.zeros(LEVELS, dtype=np.int64)
    for raw, _, kept, _ in _batches(texts):
        out += np.bincount(levels(raw)[kept], minlength=LEVELS)
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank per entropy level: the rarest 0; levels below ``LOW`` after all others."""
    order = np.lexsort((np.arange(LEVELS), counts, np.arange(LEVELS) < LOW))
    out = np.empty(LEVELS, dtype=np.int32)
    out[order] = np.arange(LEVELS, dtype=np.int32)
    return out


def _hashes(windows: np.ndarray) -> np.ndarray:
    out = np.full(len(windows), 0x243F6A8885A308D3, dtype=np.uint64)
    for word in np.ascontiguousarray(windows).view("<u8").T:
        out = (out ^ word) * _MIX
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def features(texts: Sequence[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the features, text by text in their order, equal ones once."""
    owners, hashes = [], []
    none = np.int32(np.iinfo(np.int32).max)
    for raw, valid, kept, owner in _batches(texts):
        n = len(valid)
        best = np.full(n + STRETCH, none, dtype=np.int32)
        best[STRETCH:] = np.where(valid, (ranks[levels(raw)] << PLACE_BITS) | np.arange(n, dtype=np.int32), none)
        width = 1
        while width < STRETCH:  # the least key of the stretch from each place on
            best[: len(best) - width] = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        winners = best[best != none] & ((1 << PLACE_BITS) - 1)
        at = np.flatnonzero((np.bincount(winners, minlength=n) >= WINS) & kept)
        owners.append(owner[at])
        hashes.append(_hashes(raw[at[:, None] + np.arange(WINDOW)]))
    if not owners:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(owner)), found, owner))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (found[order][1:] != found[order][:-1])
    keep = np.sort(order[first])
    return owner[keep], found[keep]


class Fingerprint:
    """Number of features and their filters, one row of bytes each."""

    __slots__ = ("n", "filters", "ones")

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters
        self.ones = np.bitwise_count(filters.view(np.uint64)).sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, _, filters = text.partition(":")
        return cls(int(n), np.frombuffer(base64.b64decode(filters), dtype=np.uint8).reshape(-1, FILTER_BITS // 8))


def fingerprints_of(texts: Sequence[bytes], ranks: np.ndarray) -> list[Fingerprint]:
    owner, found = features(texts, ranks)
    n = np.bincount(owner, minlength=len(texts))
    chain = -(-n // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(chain)])
    inside = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(n)])[owner]
    row = first[owner] + inside // FILTER_FEATURES
    bits = np.zeros((int(first[-1]), FILTER_BITS), dtype=np.uint8)
    for k in range(HASHES):
        bits[row, ((found >> np.uint64(HASH_BITS * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [Fingerprint(int(k), packed[a:b]) for k, a, b in zip(n, first[:-1].tolist(), first[1:].tolist())]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 (nothing beyond chance) to 1."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    if len(a.filters) > len(b.filters):
        a, b = b, a
    x, y = a.filters.view(np.uint64), b.filters.view(np.uint64)
    best_a, best_b = np.zeros(len(x)), np.zeros(len(y))
    for i, row in enumerate(x):
        shared = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64)
        chance = a.ones[i] * b.ones / FILTER_BITS
        score = (shared - chance) / (np.minimum(a.ones[i], b.ones) - chance)
        best_a[i] = max(0.0, score.max())
        np.maximum(best_b, score, out=best_b)

    def mean(best: np.ndarray, n: int) -> float:
        weight = np.full(len(best), FILTER_FEATURES, dtype=float)
        weight[-1] = n - FILTER_FEATURES * (len(best) - 1)
        return float((best * weight).sum() / n)

    out = mean(best_a, a.n)
    if len(x) == len(y):
        out = (out + mean(best_b, b.n)) / 2
    return min(1.0, max(0.0, out))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Windows of all texts per entropy level: one row per level reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out += level_counts([(t or "").encode() for t in batch.slice(at, 256).column(0).to_pylist()])
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["level", "k"])
        release_memory()

    out = np.zeros(LEVELS, dtype=np.int64)
    for r in docs.select(text).mapInArrow(run, "level long, k long").groupBy("level").agg(F.sum("k").alias("k")).collect():
        out[r.level] = r.k
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: np.ndarray | None = None) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every text; ``counts`` is a corpus' ``rarity``, that of ``docs`` by default."""
    ranks = ranks_of(rarity(docs, text) if counts is None else counts)

    def factory():
        def apply(doc_ids, texts):
            return {"doc_id": doc_ids, "fingerprint": list(map(str, fingerprints_of([(t or "").encode() for t in texts], ranks)))}

        return apply

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_documents(rows, "doc_id long, fingerprint string", factory)


def compared(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints (null if one is null) as ``out``."""
    schema = StructType([f for f in pairs.schema if f.name != out]).add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())
            got = [None if x is None or y is None else likeness(Fingerprint.parse(x), Fingerprint.parse(y)) for x, y in both]
            cols = {n: batch.column(n) for n in batch.schema.names if n != out} | {out: pa.array(got, pa.float64())}
            yield pa.RecordBatch.from_pydict(cols)

    return pairs.mapInArrow(run, schema)


def _in_order(docs: DataFrame, text: str, key: str, ranges: int) -> DataFrame:
    """Rows by descending key in ranges of it: ``range_``, ``halo`` (the first row of the next range, repeated here),
    ``doc_id`` and ``packed`` text. One shuffle of the packed texts; a row per range reaches the driver."""
    k, t = F.col(key).cast("long"), F.coalesce(text, F.lit(""))
    place = (k.isNull().alias("z"), F.coalesce(F.bitwise_not(k), F.lit(0)).alias("r"), F.xxhash64(t).alias("h"))
    keys = docs.select(*place).repartitionByRange(ranges, "z", "r", "h").groupBy(F.spark_partition_id().alias("p"))
    heads = sorted(tuple(x.least) for x in keys.agg(F.min(F.struct("z", "r", "h")).alias("least")).collect())
    schema = "range_ int, halo boolean, z boolean, r long, h long, doc_id long, packed binary"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for z, r, h, doc_id, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    packed, i = pack(t.encode()), bisect_right(heads, (z, r, h)) - 1
                    rows.append((i, False, z, r, h, doc_id, packed))
                    if heads[i] == (z, r, h):
                        rows.append(((i - 1) % len(heads), True, z, r, h, doc_id, packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        release_memory()

    rows = docs.select(*place, k.alias("doc_id"), t.alias("t")).mapInArrow(run, schema)
    return rows.repartition("range_").sortWithinPartitions("range_", "halo", "z", "r", "h")


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every text's fingerprint against its edited text's (the last third of its code points replaced by the first as
    many of the next document by descending key, the first one after the last) and against the next document's."""
    counts = rarity(docs, text)
    ranks = ranks_of(counts)
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    ranges = int(min(MAX_RANGES, max(parallel, counts.sum() // RANGE_BYTES)))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last; a halo only serves as the next one of the row before."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = []
        for i in own:
            t, following = rows[i][3], rows[i + 1][3]
            m = len(t) // 3
            edited.append((t[: len(t) - m] + following[:m]).encode())
        prints = fingerprints_of([r[3].encode() for r in rows], ranks)
        after = fingerprints_of(edited, ranks)
        cols = [
            [rows[i][2] for i in own], [len(rows[i][3]) for i in own], [hashlib.sha256(e).hexdigest() for e in edited],
            [str(prints[i]) for i in own], list(map(str, after)),
            [likeness(prints[i], e) for i, e in zip(own, after)], [likeness(prints[i], prints[i + 1]) for i in own],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((*row[:3], unpack(row[3]).decode()))
                size += len(rows[-1][3])
                if len(rows) > 256 or size > BATCH:
                    yield judged(rows)
                    rows, size = rows[-1:], len(rows[-1][3])
        if len(rows) > 1:  # the last row of a range is a halo
            yield judged(rows)
        rows = batch = None
        release_memory()

    return _in_order(docs, text, key, ranges).select("range_", "halo", "doc_id", "packed").mapInArrow(run, schema)
