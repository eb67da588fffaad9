"""Periodic runs, spelling variants and improbable-feature digests against plain Python."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick.llm import improbable_digest, periodic_runs, spelling_variants  # noqa: E402
from candlewick.llm.queries import QUERIES  # noqa: E402
from llm_tables import TEXTS, WORD, write_tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_tables(spark, f"{tmp_path_factory.mktemp('odd')}/rows")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# periodic runs


def plain_runs(w, power=4, least=6):
    """All periods, all stretches."""
    out = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n, root = j - i + q, w[i : i + q]
            if j > i and n >= max(least, power * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repetitive_texts(seed):
    r = random.Random(seed)
    for _ in range(20):
        docs = []
        for _ in range(r.randint(1, 4)):
            w = []
            while r.random() < 0.8:
                part = [r.choice("abc") for _ in range(r.randint(1, 4))]
                w += (part * r.randint(1, 9))[: r.randint(1, 30)]
            docs.append(w)
        power, least = r.choice((2, 3, 4)), r.choice((2, 4, 6))
        assert list(periodic_runs.runs_of_documents(docs, power, least)) == [plain_runs(w, power, least) for w in docs]


def test_runs_over_many_trees(monkeypatch):
    r = random.Random(5)
    docs = [[r.choice("ab") for _ in range(r.randint(0, 60))] for _ in range(300)]
    monkeypatch.setattr(periodic_runs, "TREE_WORDS", 100)
    assert list(periodic_runs.runs_of_documents(docs)) == [plain_runs(w) for w in docs]


def test_stretches_lose_no_run():
    r = random.Random(6)
    for _ in range(300):
        w = [r.choice("abcdefgh") for _ in range(40)] + ["x", "y"] * r.randint(1, 6) + [r.choice("abz") for _ in range(30)]
        parts = periodic_runs.stretches(w)
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in plain_runs(w))


def test_extensions_are_longest():
    r = random.Random(7)
    text = [r.choice((1, 2)) for _ in range(200)] + [0]
    of = periodic_runs.Extensions(periodic_runs.SuffixTree(text, 3)).of
    pairs = [r.sample(range(201), 2) for _ in range(2000)]

    def plain(a, b):
        n = 0
        while max(a, b) + n < 201 and text[a + n] == text[b + n]:
            n += 1
        return n

    assert of(*np.array(pairs).T).tolist() == [plain(a, b) for a, b in pairs]


def planted_words(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is None or not n:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def expected_runs(doc_id, text):
    w = planted_words(doc_id, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    rest = " ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id or 0, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))


def rows_of(df):
    return sorted(((r.doc_id or 0, *r[1:]) for r in df.collect()), key=str)


def test_runs_query_on_odd_rows(spark, odd):
    got = rows_of(QUERIES["op11_periodic_runs"](spark, odd))
    assert [r for r in got if r[0] != 6] == sorted((expected_runs(d, t) for d, t in TEXTS if d != 6), key=str)
    # 80,000 words with period 4, from word 22,914 on repeated with period 11,418: each place of a changed phase ends a run
    long = next(r for r in got if r[0] == 6)
    assert long[1:6] == (6, 0, 34332, 4, 8583000)


def test_runs_query(spark, documents):
    short = {d: t for d, t in documents if len((t or "").split()) < 3000}
    got = [r for r in rows_of(QUERIES["op11_periodic_runs"](spark, SF)) if r[0] in short]
    assert got == sorted((expected_runs(d, t) for d, t in short.items()), key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_keep_their_texts(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c d", "x")], "id long, body string, runs string")
    row = periodic_runs.find(df, text="body", key="id").collect()[0]
    assert row.collapsed == "a b c d" and [tuple(r) for r in row.runs] == [(0, 8, 2)] and row.n_words == 10


# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(20))
def test_position_index(seed):
    r = random.Random(seed)
    n = r.randint(3, 7)
    words = sorted({"".join(r.choice("abé") for _ in range(r.choice((n, n + 1)))) for _ in range(r.randint(2, 150))})
    index = spelling_variants.PositionIndex(words, n)
    for skip in (0, n // 2):
        for q in words:
            near = {w for w in words if one_edit(q, w) and n in (len(q), len(w)) and (len(w) == n or len(q) == n)}
            if len(q) > n:
                near = {w for w in near if len(w) == n}
            assert {words[j] for j in spelling_variants.members(index.near(q, skip))} == {w for w in near if not skip or w[:skip] != q[:skip]}


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()), key=str)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_variants_in_blocks(spark, block):
    r = random.Random(8)
    # one first half for most words: a hot group
    words = {"aaa" + "".join(r.choice("abcd") for _ in range(r.choice((2, 3, 4)))) for _ in range(120)} | {"".join(r.choice("ab") for _ in range(5)) for _ in range(20)}
    counts = {w: r.choice((3, 3, 6, 7, 12, 25, 60)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = spelling_variants.variants(df, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain_variants(counts)


def test_long_chains_of_forms(spark):
    chain = ["a" * 5 + "b" * k for k in range(12)]
    df = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r.word: r.root for r in spelling_variants.variants(df).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def plain_counts_of_words(docs):
    counts = collections.Counter()
    lower = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_counted_words(spark, documents):
    for docs in (documents[:60], TEXTS):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert {r.word: r.n for r in spelling_variants.counted_words(df, plant=True).collect()} == plain_counts_of_words(docs)


def test_variants_query_on_odd_rows(spark, odd):
    assert sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, odd).collect()), key=str) == plain_variants(plain_counts_of_words(TEXTS))


# improbable-feature digests


def plain_level(window):
    weight = improbable_digest._WEIGHT
    s = sum(int(weight[c]) for c in collections.Counter(window).values())
    return 1000 * (int(weight[64]) - s) // int(weight[64])


def plain_features(text, ranks):
    """Places of the features."""
    if not text:
        return []
    b = text + bytes(max(0, 64 - len(text)))
    keys = [(int(ranks[plain_level(b[i : i + 64])]), i) for i in range(len(b) - 63)]
    wins = collections.Counter(min(keys[max(0, s) : s + 64])[1] for s in range(-63, len(keys)))
    return [i for i in range(len(keys)) if wins[i] >= improbable_digest.WINS]


@pytest.mark.parametrize("piece", [1 << 18, 100])
def test_features(monkeypatch, documents, piece):
    monkeypatch.setattr(improbable_digest, "PIECE", piece)
    texts = [t.encode()[:1500] for _, t in documents[:6]] + [b"", b"short", b"a" * 500, "漢字🙂 é".encode() * 40]
    ranks = improbable_digest.ranks_of(improbable_digest.level_counts(texts))
    owner, hashes = improbable_digest.features(texts, ranks)
    for k, t in enumerate(texts):
        b, at = np.frombuffer(t + bytes(64), dtype=np.uint8), plain_features(t, ranks)
        expected = list(dict.fromkeys(improbable_digest._hashes(np.stack([b[i : i + 64] for i in at])).tolist())) if at else []
        assert hashes[owner == k].tolist() == expected


def test_level_counts():
    text = random.Random(9).randbytes(3000) + b"aaaa bbbb " * 100
    expected = collections.Counter(plain_level(text[i : i + 64]) for i in range(len(text) - 63))
    got = improbable_digest.level_counts([text])
    assert {k: int(got[k]) for k in np.flatnonzero(got).tolist()} == expected


def test_filters_hold_their_features(documents):
    texts = [t.encode() for _, t in documents]
    ranks = improbable_digest.ranks_of(improbable_digest.level_counts(texts))
    owner, hashes = improbable_digest.features(texts, ranks)
    for k, print_ in enumerate(improbable_digest.fingerprints_of(texts, ranks)):
        own = hashes[owner == k].tolist()
        assert print_.n == len(own)
        for f in range(len(print_.filters)):
            bits = {(h >> 11 * i) & 2047 for h in own[160 * f : 160 * f + 160] for i in range(5)}
            assert set(np.flatnonzero(np.unpackbits(print_.filters[f])).tolist()) == bits
        again = improbable_digest.Fingerprint.parse(str(print_))
        assert str(again) == str(print_) and improbable_digest.likeness(print_, again) == 1.0


def test_likeness_tells_edits_from_others(documents):
    texts = [t for _, t in documents if len(t) > 600][:100]
    cut = [t[: len(t) - len(t) // 3] + texts[k - 1][: len(t) // 3] for k, t in enumerate(texts)]
    raw = [t.encode() for t in texts]
    ranks = improbable_digest.ranks_of(improbable_digest.level_counts(raw))
    a, b = (improbable_digest.fingerprints_of(x, ranks) for x in (raw, [t.encode() for t in cut]))
    same = [improbable_digest.likeness(x, y) for x, y in zip(a, b)]
    other = [improbable_digest.likeness(x, y) for x, y in zip(a, a[1:]) if str(x) != str(y)]
    assert np.median(same) > 0.5 and np.median(other) < 0.1
    assert all(improbable_digest.likeness(x, y) == improbable_digest.likeness(y, x) for x, y in zip(a, b))


def expected_digests(docs):
    order = sorted(docs, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    texts = [t or "" for _, t in order]
    raw = [t.encode() for t in texts]
    ranks = improbable_digest.ranks_of(improbable_digest.level_counts(raw))
    edited = [(t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3]).encode() for i, t in enumerate(texts)]
    a, b = improbable_digest.fingerprints_of(raw, ranks), improbable_digest.fingerprints_of(edited, ranks)
    return sorted(((d or 0, len(t), hashlib.sha256(e).hexdigest(), str(x), str(y), improbable_digest.likeness(x, y), improbable_digest.likeness(x, z))
                   for (d, _), t, e, x, y, z in zip(order, texts, edited, a, b, [*a[1:], a[0]])), key=str)


def test_digest_query(spark, documents):
    assert rows_of(QUERIES["op13_improbable_digest"](spark, SF)) == expected_digests(documents)


def test_digest_query_on_odd_rows(spark, odd):
    assert rows_of(QUERIES["op13_improbable_digest"](spark, odd)) == expected_digests(TEXTS)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_order_over_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(improbable_digest, "RANGE_BYTES", 1)
    monkeypatch.setattr(improbable_digest, "MAX_RANGES", ranges)
    docs = [(int(i), f"{'text ' * (i % 50)}{i}") for i in range(-150, 150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows_of(improbable_digest.with_edits(df)) == expected_digests(docs)


def test_digest_of_a_single_document(spark):
    row = improbable_digest.with_edits(spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and row.near_next == 1.0


def test_fingerprints_and_comparison(spark):
    df = spark.createDataFrame([(1, "some text " * 30), (2, "some text " * 30), (3, "")], "id long, body string")
    prints = {r.doc_id: r.fingerprint for r in improbable_digest.fingerprints(df, "body", "id").collect()}
    assert prints[1] == prints[2] and prints[3] == "0:"
    pairs = spark.createDataFrame([(prints[1], prints[2], "x"), (prints[1], prints[3], "y"), (None, prints[3], "z"), (prints[3], prints[3], "w")], "a string, b string, likeness string")
    assert [r.likeness for r in improbable_digest.compared(pairs, "a", "b").collect()] == [1.0, 0.0, None, 1.0]
