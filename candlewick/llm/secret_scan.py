"""Secret scans over a trigram inverted index.

Each rule is a regular expression. When a plan is built, its syntax tree gives a Boolean
query over trigrams that any match must contain (lower-cased), as a disjunction of sets of
trigrams. One pass over the texts makes postings (trigram, doc_id) for the trigrams that the
rules ask for; a join with the small table of queries and a count per (document, rule, set)
intersects them. Only documents found that way are verified with a rule's expression; rules
without mandatory trigrams (a bare run of hex digits) scan all texts.

Postings hold ids, never texts, and are grouped by document, so a trigram that a third of
all documents contain costs no more than its rows. Candidates go back to the texts by a
broadcast if their counted number is small enough (``common.few``), else by a shuffle join.

Spans are code points, end exclusive, leftmost and non-overlapping per kind: a text split at
a rule's matches and the matches themselves give all positions by running sums of lengths.

Edge cases: null text is empty; rows with equal doc_id share candidates but are each verified
on their own text; null doc_id is a document too; spans of different kinds may overlap; an
empty table gives an empty result; further columns are kept by ``scan``, but for one named
``found``, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import few, unused, written

#: Strings that a part of a rule is followed exactly for, and their length; beyond, less is required.
MAX_STRINGS, MAX_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` or more characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which equal starts are listed. A run of one class
#: ends where the class does, so a minimum length inside the pattern drops the same matches as a later test.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats of well-known credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A query: any of these sets of trigrams; one empty set asks for nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset({frozenset()})


@dataclass
class Part:
    """What a part of a rule matches: exactly ``strings`` (None: too many), else strings that begin with
    one of ``starts``, end with one of ``ends`` and satisfy ``query``."""

    strings: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simpler(sets: Query) -> Query:
    """Drops sets that ask for all that another one does, and more."""
    kept = frozenset(a for a in sets if not any(b < a for b in sets))
    return kept if len(kept) <= MAX_STRINGS else ANYTHING


def _both(a: Query, b: Query) -> Query:
    joined = _simpler(frozenset(x | y for x, y in product(a, b)))
    return joined if joined != ANYTHING else (a if a != ANYTHING else b)


def _any_of(strings: frozenset[str]) -> Query:
    return _simpler(frozenset(_trigrams(s) for s in strings))


NOTHING_KNOWN = Part(None, frozenset({""}), frozenset({""}), ANYTHING)
EMPTY = Part(frozenset({""}), frozenset({""}), frozenset({""}), ANYTHING)


def _exactly(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, ANYTHING)


def _open(p: Part) -> Part:
    """The part without its exact strings, which become a query and two edges."""
    if p.strings is None:
        return p
    return Part(None, frozenset(s[:3] for s in p.strings), frozenset(s[-2:] for s in p.strings), _both(p.query, _any_of(p.strings)))


def _then(a: Part, b: Part) -> Part:
    if a.strings is not None and b.strings is not None and len(a.strings) * len(b.strings) <= MAX_STRINGS:
        return _exactly(frozenset(x + y for x, y in product(a.strings, b.strings)))
    left, right = a.strings if a.strings is not None else a.ends, b.strings if b.strings is not None else b.starts
    across = _any_of(frozenset(x[-2:] + y[:2] for x, y in product(left, right)))
    x, y = _open(a), _open(b)
    starts = x.starts if a.strings is None else frozenset((s + t)[:3] for s, t in product(a.strings, y.starts))
    ends = y.ends if b.strings is None else frozenset((s + t)[-2:] for s, t in product(x.ends, b.strings))
    return Part(None, starts, ends, _both(_both(x.query, y.query), across))


def _either(parts: list[Part]) -> Part:
    if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MAX_STRINGS:
        return _exactly(frozenset().union(*(p.strings for p in parts)))
    parts = [_open(p) for p in parts]
    return Part(None, *(frozenset().union(*(getattr(p, k) for p in parts)) for k in ("starts", "ends")), _simpler(frozenset().union(*(p.query for p in parts))))


def _class(items: list) -> Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            chars.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < MAX_CLASS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return NOTHING_KNOWN
    return _exactly(frozenset(chars)) if 0 < len(chars) <= MAX_CLASS else NOTHING_KNOWN


def _part(nodes) -> Part:
    out = EMPTY
    for kind, value in nodes:
        if kind is C.LITERAL:
            one = _exactly(frozenset({chr(value).lower()}))
        elif kind is C.IN:
            one = _class(value)
        elif kind is C.SUBPATTERN:
            one = _part(value[3])
        elif kind is C.ATOMIC_GROUP:
            one = _part(value)
        elif kind is C.BRANCH:
            one = _either([_part(b) for b in value[1]])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = value
            inner = _part(body)
            if least == 0:
                one = _either([inner, EMPTY]) if most == 1 and inner.strings is not None else NOTHING_KNOWN
            else:
                one = inner
                for _ in range(min(least, 3) - 1):
                    one = _then(one, inner)
                if most != least or least > 3:
                    one = _open(one)
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            one = EMPTY
        else:
            one = NOTHING_KNOWN
        out = _then(out, one)
    return out


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text without which the expression can't match."""
    return _open(_part(_parser.parse(pattern))).query


def postings(docs: DataFrame, trigrams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """trigram, ``key``: one row per document and trigram of the list that its lower-cased text has."""
    low = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    has = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return low.select(key, F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query], key: str = "doc_id") -> DataFrame:
    """``key`` and ``rules``: the rules whose query a document's postings satisfy."""
    spark = index.sparkSession
    asked = [(name, i, t, len(s)) for name, q in queries.items() for i, s in enumerate(sorted(q, key=sorted)) for t in sorted(s)]
    table = F.broadcast(spark.createDataFrame(asked, "rule string, part int, trigram string, needed int"))  # as long as the rules
    met = index.join(table, "trigram").groupBy(key, "rule", "part", "needed").agg(F.countDistinct("trigram").alias("met"))
    return met.where("met = needed").groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """Array of (start, kind's number, end) of a rule's matches."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m).cast("long"))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["piece"]
        end = begin + m["whole"]
        one = F.array(F.struct(begin.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["tested"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # after the last match there is one piece more, which the slice leaves out
    matches = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("whole"), tested.alias("tested")), _match)
    return F.aggregate(matches, start, add, lambda acc: acc["found"]).cast(kind)


def _match(piece: Column, lengths: Column) -> Column:
    return F.struct(piece.alias("piece"), lengths["whole"].alias("whole"), lengths["tested"].alias("tested"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns and ``found``: the spans (start, kind as the rule's number, end), by start, then kind."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q != ANYTHING}
    rows, of, asked_of = docs, unused(docs, "_key"), unused(docs, "_rules")
    none = F.array().cast("array<string>")
    if indexed:
        index = postings(docs, sorted({t for q in indexed.values() for s in q for t in s}), text, key)
        found = candidates(index, indexed, key).select(F.col(key).alias(of), F.col("rules").alias(asked_of))
        side = few(written(found, "secret-candidates"))
        rows = docs.join(side, docs[key].eqNullSafe(F.col(of)), "left").drop(of)
    else:
        rows = docs.withColumn(asked_of, none)
    value = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    per_rule = []
    for k, rule in enumerate(rules):
        asked = F.array_contains(asked_of, rule.name) if rule.name in indexed else F.regexp_like(value, F.lit(rule.pattern))
        per_rule.append(F.when(F.coalesce(asked, F.lit(False)), _spans(value, rule, k)).otherwise(empty))
    return rows.withColumn("found", F.sort_array(F.concat(*per_rule))).drop(asked_of)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    return scanned.select("doc_id", *counts, F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("found"), rules).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        before = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["parts"], F.array(before, F.lit(mark)))
        parts = F.when(s["start"] >= acc["at"], new).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int")))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, finish)).otherwise(text)
