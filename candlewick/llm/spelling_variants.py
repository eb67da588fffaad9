"""Spelling variants: words one code point apart, by a bit-sliced position index.

The index of a group of words has a bitset per (position, letter): the words with that letter
there. A word is looked up with four sets that advance letter by letter, for all words of the
group at once, a machine word at a time:

* no error so far: ``zero & index[i, c]``;
* one replaced letter: ``(replaced & index[i, c]) | (zero & ~index[i, c])``;
* the other word has one letter more, so its places are shifted by one:
  ``(longer & index[i + 1, c]) | zero``, of the sets after this letter;
* the other word has one letter less: ``(shorter & index[i - 1, c]) | zero``, before it.

Groups. Two words one edit apart, the shorter of n letters, agree in their first or in their
last n // 2 letters, whichever the edit is not in. So every word stands in groups by its first
and by its last half, once as the shorter and once as the longer word, and only words of one
group meet. A pair that agrees in both halves is counted by the first. Groups above ``BLOCK``
words are cut into blocks by hash, and each block of queries meets each block of the index.
Rows are narrow and leave a block as one row per word with near words, never as pairs.

Words are counted by partial sums before the shuffle, so a word that is a third of all text
arrives once per task.

Edge cases: null and empty texts have no words; a null doc_id plants no misspelling; words of
equal counts near a word go by code-point order; repeated rows count again; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import release_memory, written

MIN_LENGTH, MIN_COUNT = 5, 3
#: A variant's form is found at least so many times as often.
MORE_OFTEN = 2
#: Words of a group's block, the most that one index holds.
BLOCK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PositionIndex:
    """Bitsets per (position, letter) over words of ``length`` letters or one more."""

    def __init__(self, words: Sequence[str], length: int):
        bits: dict[tuple[int, str], list[int]] = {}
        long = []
        for j, w in enumerate(words):
            for at in enumerate(w):
                bits.setdefault(at, []).append(j)
            if len(w) > length:
                long.append(j)
        n = len(words)
        self.all, self.length = (1 << n) - 1, length
        self.at = {at: _bitset(js, n) for at, js in bits.items()}
        self.long = _bitset(long, n)
        self.short = self.all & ~self.long

    def near(self, word: str, skip_prefix: int = 0) -> int:
        """The words one error away, as bits: for a word of ``length`` letters those as long or one longer, for a longer
        one the shorter ones. Words that share the first ``skip_prefix`` letters are left out."""
        at, every, last = self.at.get, self.all, len(word) - 1
        zero, skip = every, 0
        if last < self.length:
            replaced, longer = 0, every  # the letter more may come first
            for i, c in enumerate(word):
                here = at((i, c), 0)
                longer &= at((i + 1, c), 0)
                replaced = replaced & here | zero & ~here
                zero &= here
                longer |= zero
                if i + 1 == skip_prefix:
                    skip = zero
            found = replaced & self.short | longer & self.long
        else:
            shorter = 0
            for i, c in enumerate(word):
                shorter = shorter & at((i - 1, c), 0) | zero
                zero &= at((i, c), 0)
                if i + 1 == skip_prefix:
                    skip = zero
            found = shorter & self.short
        return found & ~skip


def _bitset(members: list[int], n: int) -> int:
    if n <= 64 or len(members) < 16:
        out = 0
        for j in members:
            out |= 1 << j
        return out
    raw = bytearray((n + 7) // 8)
    for j in members:
        raw[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(raw, "little")


def members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def near_in_group(index_words: Sequence[str], queries: Iterable[str], length: int, last_half: bool) -> Iterator[tuple[int, list[int]]]:
    """(number of the query, numbers of the index words near it), for queries that have any."""
    index = PositionIndex(index_words, length)
    skip = length // 2 if last_half else 0
    for k, q in enumerate(queries):
        if found := index.near(q, skip):
            yield k, list(members(found))


def _in_groups(words: DataFrame) -> DataFrame:
    """Words by group: ``last`` (by the last half), ``size`` (letters of the group's shorter words) and ``half``."""
    n = F.length("word")
    kinds = F.array(*[F.struct(F.lit(last).alias("last"), (n - less).alias("size")) for last in (False, True) for less in (0, 1)])
    rows = words.select("word", "n", F.explode(kinds).alias("g")).select("word", "n", "g.last", "g.size")
    k = F.floor(F.col("size") / 2).cast("int")
    half = F.when(F.col("last"), F.expr("right(word, cast(floor(size / 2) as int))")).otherwise(F.substring("word", F.lit(1), k))
    return rows.withColumn("half", half)


def _met(words: DataFrame, block: int) -> DataFrame:
    """Rows of every meeting (group, query block, index block): ``x``, ``y`` and whether the row is a query, in the index, or both."""
    rows, key = _in_groups(words), ["last", "size", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows_")).where(F.col("rows_") > block)
    sizes = sizes.select(*key, F.ceil(F.col("rows_") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # in meeting (b, o) a query, in meeting (o, b) in the index, in (b, b) both
    meetings = F.flatten(F.transform(others, lambda o: F.when(o == F.col("b"), F.array(F.struct(F.col("b").alias("x"), o.alias("y"), F.lit(3).alias("role")))).otherwise(
        F.array(F.struct(F.col("b").alias("x"), o.alias("y"), F.lit(1).alias("role")), F.struct(o.alias("x"), F.col("b").alias("y"), F.lit(2).alias("role"))))))
    return rows.select("word", "n", *key, F.explode(meetings).alias("m")).select("word", "n", *key, "m.x", "m.y", "m.role")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of distinct words (``word``, ``n``): per word and meeting with near words ``word``, ``n`` and ``near``, a list of (word, n)."""
    schema = "word string, n long, near array<struct<word:string,n:long>>"
    out = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])
    key = ["last", "size", "half", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, queries, rows = None, [], [], []

        def meet() -> None:
            if len(index) > 1 or index != queries:
                found = near_in_group([w for w, _ in index], [w for w, _ in queries], now[1], now[0])
                rows.extend((*queries[k], [{"word": index[j][0], "n": index[j][1]} for j in js]) for k, js in found)

        def taken() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [(), (), ()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *group, word, n, role in zip(*cols):
                if group != now:
                    if now:
                        meet()
                    now, index, queries = group, [], []
                if role & 1:
                    queries.append((word, n))
                if role & 2:
                    index.append((word, n))
            if len(rows) >= 10_000:
                yield taken()
        if now:
            meet()
        yield taken()
        release_memory()

    met = _met(words, block).select(*key, "word", "n", "role")
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def best_near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per word with near words: ``n_near`` and ``best``, the near word (word, n) of largest n, the first in code-point order."""
    some = near_words(words, block).select(
        "word", F.size("near").cast("long").alias("k"),
        F.array_min(F.transform("near", lambda w: F.struct((-w.n).alias("less"), w.word.alias("word")))).alias("b"),
    )
    return some.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("b").alias("b")).select(
        "word", "n_near", F.struct(F.col("b.word").alias("word"), (-F.col("b.less")).alias("n")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of rows (``word``, ``form``): forms followed to the last, by doubling. Counts at least double
    from word to form, so six rounds reach any count below 2^63; rounds end once nothing moves."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").isEmpty()
        now = now.select("word", "root")
        if not moved:
            return now


def counted_words(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False, length: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n`` of the words of all texts, maximal runs of Latin letters with A-Z lower-cased, of at least
    ``length`` letters and found ``least`` times or more. ``plant`` takes a letter from about every 97th word, by a
    hash of its doc_id and word."""
    # runs of too few letters can only get shorter
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]{%d,}" % length), F.lit(0))
    rows = docs.select(F.col(key).cast("string").alias("d"), F.explode(found).alias("w"))
    if plant:
        h = F.crc32(F.concat("d", F.lit(":"), "w"))
        at = (h % F.length("w")).cast("int")
        less = F.concat(F.substring("w", F.lit(1), at), F.expr("substring(w, cast(crc32(concat(d, ':', w)) % length(w) as int) + 2)"))
        rows = rows.select(F.when(h % 97 == 0, less).otherwise(F.col("w")).alias("w")).where(F.length("w") >= length)
    return rows.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def variants(words: DataFrame, more: int = MORE_OFTEN, block: int = BLOCK) -> DataFrame:
    """Per word of (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = written(words, "vocabulary")
    near = best_near(words, block).withColumnRenamed("word", "w_")
    rows = words.join(near, F.col("word") == F.col("w_"), "left")
    fits = F.col("best.n") >= more * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n"))
    rows = written(rows, "near")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "w_")
    rows = rows.join(ends, F.col("word") == F.col("w_"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The query in SQL: crc32 byte by byte over hexadecimal digits, near words by the words with one letter left out.
ORACLE = r"""
WITH RECURSIVE crc_bits(i, k, v) AS (
    SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS w FROM documents),
keyed AS (SELECT doc_id, w, count(*) AS c, row_number() OVER () AS id FROM runs GROUP BY doc_id, w),
crc(id, x, v) AS (
    SELECT id, lower(hex(encode(doc_id || ':' || w))), 4294967295 FROM keyed WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT id, x[3:], xor(v >> 8, t[(xor(v, 16 * (instr('0123456789abcdef', x[1]) - 1) + instr('0123456789abcdef', x[2]) - 1) & 255) + 1])
    FROM crc, crc_table WHERE x <> ''),
hashed AS (SELECT keyed.w, keyed.c, xor(crc.v, 4294967295) AS h FROM keyed LEFT JOIN crc ON crc.id = keyed.id AND crc.x = ''),
planted AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, n, i, word[:i] || word[i + 2:] AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT word, v FROM less WHERE v IN (SELECT word FROM words)
    UNION SELECT v, word FROM less WHERE v IN (SELECT word FROM words)),
near AS (
    SELECT p.word, count(*) AS n_near, min(struct_pack(less := -o.n, word := o.word)) AS best
    FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.word END AS form,
        CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
    FROM words w LEFT JOIN near ON near.word = w.word),
followed(word, root) AS (
    SELECT word, word FROM formed UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n
FROM formed f JOIN followed e ON e.word = f.word JOIN formed last ON last.word = e.root AND last.form IS NULL
"""
