"""Token-ID files: independent zstandard frames with a trailing seek table.

A file holds documents in ascending doc_id order:

* frames, each a zstandard frame of its own over a few documents. Unpacked: the number of
  documents and the width of an id as u32, then per document its null mark (u8), doc_id
  (i64) and count of ids (u64), then all ids (u16 if the vocabulary allows, else u32);
* the seek table, in a zstandard skippable frame so that any zstandard reader passes over
  it: per frame the packed size, the unpacked size, the CRC-32 of the unpacked bytes, the
  number of documents (u32 each), first and last doc_id (i64) and number of ids (u64);
  then the file's place in the whole order (task and turn, u32 each), the number of
  frames (u32), the format's version (u8), the mark ``CWSEEK`` and a line feed.

All numbers are little-endian. A reader takes the tail, finds the frames of the documents
it wants, and unpacks those only, each checked by its CRC-32.

Files are written by Spark's own text sink, one record (file) each, so they appear only
when their task commits, on any store that Spark can write; the closing line feed is the
sink's record end and part of the format. They are read back with ``binaryFile``.

Edge cases: null text is empty and has only the end id; null doc_id comes first; rows with
equal doc_id stay together, ordered by text; a document longer than a frame gets a frame of
its own; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import map_documents, per_worker, release_memory, scratch_path, written

#: Fixed value: appended to every document.
END_ID = 1
SKIPPABLE, MARK, VERSION = 0x184D2A5E, b"CWSEEK", 1
ENTRY, TAIL = "<IIIIqqQ", "<IIIB6s"
#: Ids per frame and packed bytes per file, from which on a new one begins.
FRAME_IDS, FILE_BYTES = 1 << 16, 8 << 20
#: Bytes of kept pieces per Python worker, with what an entry costs besides; beyond, the table is emptied and grows anew.
MAX_BYTES, PIECE_COST = 300_000_000, 150
#: Bytes of text that are cut into pieces at a time.
SLICE_BYTES = 4 << 20
#: ASCII punctuation without the apostrophe, which begins endings that the tokenizer splits off.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
TRIAL = "the quick brown fox jumps over a lazy dog while zyxqv internationalization wanders"
MARK_AFTER_LETTER = re.compile(r"[.,;:!?](?<=[a-z].)(?=[ \n])")
#: Documents per range of the order, and ranges at most.
RANGE_DOCS, MAX_RANGES = 8_192, 20_000


class Ids:
    """Piece of text between spaces to its ids, by the tokenizers library; made on first use.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those
    of its pieces, one after the other. New pieces of letters are single words and encoded
    many at a time, as one text, cut after each id that ends a word. ASCII punctuation after
    a letter or digit is a word of its own, so such pieces are put together from two. Both
    hold for a piece as the tokenizer's normalizer leaves it: it may turn a letter into
    one with a mark, which is no letter. Pieces with an added token's string stay whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.dtype = np.dtype(dtype)
        self.tokenizer = Tokenizer.from_file(path)
        # the same merges without the normalizer and the splitting rules, which leave words of a-z as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        if self.ids(TRIAL, self.plain).tolist() != self.ids(TRIAL).tolist():
            self.plain = self.tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # an added token's string ends words by itself
        self.ends[[i for i in self.tokenizer.get_added_tokens_decoder() if i < len(self.ends)]] = False
        self.lowers = self.normal("Éa A").replace(" ", "") == "éaa"
        self.known: dict[str, bytes] = {}
        self.size = 0

    def normal(self, text: str) -> str:
        return text if not self.tokenizer.normalizer else self.tokenizer.normalizer.normalize_str(text)

    def words(self, pieces: set[str]) -> set[str]:
        """The pieces of letters only, before and after the normalizer: one word each for the tokenizer."""
        letters = [p for p in pieces if p.isalpha()]
        out = {p for p in letters if p.isascii()}
        other = [p for p in letters if p not in out]
        normal = self.normal(" ".join(other)).split(" ") if other else []
        return out.union(p for p, n in zip(other, normal) if n.isalpha()) if len(normal) == len(other) else out

    def split(self, piece: str) -> tuple[str, str]:
        """The piece without the punctuation after it, and that."""
        core = piece.rstrip(PUNCTUATION)
        if not core or not core[-1].isalnum() or not (core[-1].isascii() or self.normal(core[-1])[-1:].isalnum()):
            return piece, ""
        low = piece.lower()
        return (piece, "") if any(t in low for t in self.added) else (core, piece[len(core) :])

    def ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def learn_words(self, words: list[str], tokenizer=None) -> None:
        """Words as one text; halves of it, should a word be more than one for the tokenizer."""
        ids = self.ids(" ".join(words), tokenizer)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) if len(ids) and int(ids.max()) < len(self.ends) else []
        if len(cuts) == len(words):
            raw, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
            self.known.update(zip(words, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        elif len(words) == 1:
            self.known[words[0]] = ids.tobytes()
        else:
            half = len(words) // 2
            self.learn_words(words[:half])
            self.learn_words(words[half:])

    def learn(self, pieces: set[str]) -> None:
        known = self.known
        words = self.words(pieces)
        others = list(pieces.difference(words))
        both = [self.split(p) for p in others]
        parts = {p for b in both for p in b}.difference(known)
        words.update(self.words(parts))
        rest = parts.difference(words)
        simple = [w for w in words if w.isascii() and w.islower()]
        for some, tokenizer in ((simple, self.plain), (list(words.difference(simple)), None)):
            for at in range(0, len(some), 4096):
                self.learn_words(some[at : at + 4096], tokenizer)
        for p in rest:
            known[p] = self.ids(p).tobytes()
        known.update(zip(others, [known[core] + known[tail] if tail else known[core] for core, tail in both]))
        self.size += sum(map(len, pieces)) + sum(map(len, parts)) + PIECE_COST * (len(pieces) + len(parts))

    def prepared(self, text: str) -> str:
        """A text of the same ids whose pieces are fewer: A-Z lower-cased, as the normalizer does, and a mark after a letter apart.

        A text that would compose other characters then, or holds an added token's string, is left as it is.
        """
        if not self.lowers:
            return text
        low = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: A-Z only
        if any(t in low for t in self.added) or not low.isascii() and not (is_normalized("NFC", text) and is_normalized("NFC", low)):
            return text
        return MARK_AFTER_LETTER.sub(r" \g<0>", low)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > MAX_BYTES:
            self.known.clear()
            self.size = 0
        # Arrow cuts, numbers and joins the pieces: Python meets each different piece once a call
        lists = pc.split_pattern(pa.array([self.prepared(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, pieces))
        if None in found:
            self.learn({p for p, ids in zip(pieces, found) if ids is None})
            found = list(map(self.known.__getitem__, pieces))
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = joined.buffers()
        bounds = np.frombuffer(offsets, dtype="<i8")[lists.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def by_bytes(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``SLICE_BYTES`` of text; a longer text is not cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8")
    turns = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Writer:
    """Documents in, whole files out."""

    def __init__(self, task: int, dtype: str, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.task, self.turn, self.dtype = task, 0, np.dtype(dtype)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.docs: list[tuple[int | None, bytes]] = []
        self.ids = self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> bytes | None:
        """Take a document; a file once it is large enough."""
        self.docs.append((doc_id, ids))
        self.ids += len(ids) // self.dtype.itemsize
        if self.ids >= FRAME_IDS:
            self.end_frame()
            if self.size >= FILE_BYTES:
                return self.end_file()
        return None

    def end_frame(self) -> None:
        if not self.docs:
            return
        width = self.dtype.itemsize
        known = [d or 0 for d, _ in self.docs]
        raw = b"".join((
            struct.pack("<II", len(self.docs), width), bytes(d is None for d, _ in self.docs),
            np.array(known, dtype="<i8").tobytes(), np.array([len(x) // width for _, x in self.docs], dtype="<u8").tobytes(),
            *(x for _, x in self.docs),
        ))
        packed = self.pack(raw)
        self.frames.append(packed)
        self.entries.append(struct.pack(ENTRY, len(packed), len(raw), zlib.crc32(raw), len(self.docs), known[0], known[-1], self.ids))
        self.size += len(packed)
        self.docs, self.ids = [], 0

    def end_file(self) -> bytes | None:
        """The file without its closing line feed, which the sink writes."""
        self.end_frame()
        if not self.frames:
            return None
        table = b"".join(self.entries) + struct.pack(TAIL, self.task, self.turn, len(self.entries), VERSION, MARK)
        out = b"".join((*self.frames, struct.pack("<II", SKIPPABLE, len(table) + 1), table))
        self.turn += 1
        self.clear()
        return out


@dataclass
class Frame:
    offset: int
    packed: int
    unpacked: int
    crc32: int
    n_docs: int
    first: int
    last: int
    n_ids: int


class Reader:
    """Random access to a token file (any seekable binary file)."""

    def __init__(self, file: BinaryIO):
        self.file = file
        end = file.seek(0, 2)
        entry, tail = struct.calcsize(ENTRY), struct.calcsize(TAIL) + 1
        if end < tail:
            raise ValueError("not a token file")
        file.seek(end - tail)
        last = file.read(tail)
        self.task, self.turn, n, version, mark = struct.unpack(TAIL, last[:-1])
        if mark != MARK or version != VERSION or last[-1:] != b"\n":
            raise ValueError("not a token file")
        file.seek(end - tail - n * entry)
        entries, at, self.frames = file.read(n * entry), 0, []
        for e in struct.iter_unpack(ENTRY, entries):
            self.frames.append(Frame(at, *e))
            at += e[0]

    def documents(self, frame: Frame) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of the documents of one frame, which is checked."""
        import zstandard

        self.file.seek(frame.offset)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(frame.packed), max_output_size=frame.unpacked)
        if zlib.crc32(raw) != frame.crc32:
            raise ValueError(f"frame at {frame.offset}: checksum differs")
        n, width = struct.unpack_from("<II", raw)
        nulls, at = raw[8 : 8 + n], 8 + n
        doc_ids = np.frombuffer(raw, "<i8", n, at).tolist()
        counts = np.frombuffer(raw, "<u8", n, at + 8 * n).tolist()
        at += 16 * n
        for null, doc_id, count in zip(nulls, doc_ids, counts):
            yield None if null else doc_id, np.frombuffer(raw, f"<u{width}", count, at)
            at += count * width

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for frame in self.frames:
            yield from self.documents(frame)

    def get(self, wanted: Iterable[int]) -> dict[int, np.ndarray]:
        """Ids of the wanted documents; unpacks only frames that may hold one."""
        wanted, out = set(wanted), {}
        for frame in self.frames:
            if any(frame.first <= d <= frame.last for d in wanted):
                out |= {d: ids for d, ids in self.documents(frame) if d in wanted}
        return out


def write_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = END_ID) -> None:
    """Encode every whole text and write the files; their order is that of ``key``.

    Rows are dealt to tasks by ranges of the key, so files follow one another and no task
    holds more than its range; texts, not ids, are shuffled, so encoding runs once.
    """
    dtype = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gc.set_threshold(1_000_000)  # the table of pieces is large and holds no cycles
        ids, writer = None, Writer(TaskContext.get().partitionId(), dtype)
        end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
        for batch in batches:
            # a worker's later tasks find the pieces that earlier ones learned
            ids = ids if ids is not None else per_worker(f"token ids {tokenizer} {dtype}", lambda: Ids(tokenizer, dtype))
            for part in by_bytes(batch):
                doc_ids, texts = (c.to_pylist() for c in part.columns)
                for doc_id, x in zip(doc_ids, ids.encode([t or "" for t in texts])):
                    if file := writer.add(doc_id, x + end):
                        yield pa.RecordBatch.from_pydict({"file": [file]})
        if file := writer.end_file():
            yield pa.RecordBatch.from_pydict({"file": [file]})
        ids = writer = batch = None
        release_memory()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    ranges = min(MAX_RANGES, max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // RANGE_DOCS)))
    # rows of one key are dealt by how their texts begin
    rows = rows.repartitionByRange(ranges, F.col("k").asc_nulls_first(), F.substring("t", 1, 32)).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    files = rows.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """task, turn, doc_id, at (ids before it in its file), n_tokens and ids_crc32 of every document."""

    def factory():
        import io

        def apply(contents):
            out = {c: [] for c in ("task", "turn", "doc_id", "at", "n_tokens", "ids_crc32")}
            for content in contents:
                reader, at = Reader(io.BytesIO(content)), 0
                for doc_id, ids in reader.all():
                    row = (reader.task, reader.turn, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for c, v in zip(out, row):
                        out[c].append(v)
                    at += len(ids)
            return out

        return apply

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_documents(files, "task long, turn long, doc_id long, at long, n_tokens long, ids_crc32 long", factory, step=1)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, over all files. One row per file is ordered as a whole."""
    totals = rows.groupBy("task", "turn").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("task", "turn").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("task", "turn", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return rows.join(totals, ["task", "turn"]).withColumn("start", F.col("before") + F.col("at"))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_files(docs, path, tokenizer, text)
    rows = written(read_files(spark, path), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
