"""The operators' parts against brute force: no Spark session needed."""

import io
import os
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick.llm import bpe, html_text, near_dedup, quality_gam, quality_rules, secret_scan, token_files, vector_search  # noqa: E402
from candlewick.llm.docstats import FEATURES, Statistics, repeated_words  # noqa: E402
from llm_tables import plain_counts  # noqa: E402


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def both(ranks):
    import tiktoken

    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(both):
    ours, theirs = both

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert ours.encode(text) == theirs.encode_ordinary(text)

    same()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=40))
def test_ascii_pattern_splits_alike(text):
    assert re.findall(bpe.ASCII_PATTERN, text, re.ASCII) == regex.findall(bpe.PATTERN, text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghij", "é漢🙂", " \n\t", "0123", "!?-"])
def test_long_pieces(both, alphabet):
    ours, theirs = both
    text = "".join(random.Random(7).choices(alphabet, k=9000))
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_ranks_without_merge_order_use_plain_merging():
    odd = {bytes((i,)): i for i in range(256)} | {b"abc": 256, b"bc": 257}
    t = bpe.Transducer(odd)
    for text in (b"abcabc", b"bcabc", b"aabbcc"):
        assert t.encode(text) == ([odd[text]] if text in odd else t.merged(text))


def test_decoding_streams_whole_characters(ranks):
    d, e = bpe.Decoder(ranks), bpe.Encoder(ranks)
    text = "aé漢🙂 end"
    assert d.decode_bytes(e.encode(text)).decode() == text
    for chunk in (1, 2, 3, 7):
        assert "".join(d.stream(e.encode(text), chunk)) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_stream_equals_decoding_at_once(data, size):
    s = bpe.Utf8Stream()
    parts = [s.feed(data[i : i + size]) for i in range(0, len(data), size)] + [s.close()]
    assert "".join(parts) == data.decode("utf-8", errors="replace")


# token files


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    ids = token_files.Ids(path, "<u2")

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*"aAzZéÉ'.,!* \n1²ſßΣ<|>İक़", "<|endoftext|>", "<|startoftext|>"])), max_size=40).map("".join))
    def same(text):
        assert np.frombuffer(ids.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids

    same()
    for text in ("BELEDİYESİ.", "BELEDİYESİ, İ__", "a İ! b", "x <|endoftext|> y", "a<|endoftext|>.b", "<|ENDOFTEXT|>!", "क़.", "İ İİ. iI."):
        same.hypothesis.inner_test(text)
    ids.size = token_files.MAX_BYTES + 1  # the table is emptied and grows anew
    same.hypothesis.inner_test("again İ. <|endoftext|>, words")
    assert len(ids.known) < 10


def token_file(docs, frame=8):
    w = token_files.Writer(3, "<u2")
    old, token_files.FRAME_IDS = token_files.FRAME_IDS, frame
    try:
        for d, ids in docs:
            assert w.add(d, np.array(ids, "<u2").tobytes()) is None
        return w.end_file() + b"\n"
    finally:
        token_files.FRAME_IDS = old


def test_random_access_unpacks_only_wanted_frames(monkeypatch):
    docs = [(None, [1])] + [(i, list(range(i + 1))) for i in range(40)]
    reader = token_files.Reader(io.BytesIO(token_file(docs)))
    assert [(d, ids.tolist()) for d, ids in reader.all()] == docs
    read = []
    original = token_files.Reader.documents
    monkeypatch.setattr(token_files.Reader, "documents", lambda self, f: (read.append(f), original(self, f))[1])
    assert reader.get([30])[30].tolist() == list(range(31))
    assert len(reader.frames) > 10 and len(read) == 1


def test_files_are_plain_zstandard_and_checked():
    import zstandard

    data = token_file([(1, [5, 6, 7])])
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()[:4] == b"\x01\x00\x00\x00"
    reader = token_files.Reader(io.BytesIO(data))
    reader.frames[0].crc32 ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.all())
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(data[:-1]))


# near duplicates


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24), st.integers(0, 24))
def test_banded_distance(a, b, limit):
    expected = edit(a, b)
    assert near_dedup.banded_distance(np.array(a, dtype=int), np.array(b, dtype=int), limit) == min(expected, limit + 1)


def test_sketches_find_pairs_at_the_threshold():
    random_ = np.random.default_rng(5)
    sketch, missed, kept_order, shuffled = near_dedup.Sketch(), 0, 0, 0
    for _ in range(300):
        a = random_.integers(0, 1 << 62, 300, dtype=np.uint64)
        b = a.copy()
        at = random_.choice(60, 6, replace=False) * 5  # six edits that share no k-mer
        b[at] = random_.integers(0, 1 << 62, 6, dtype=np.uint64)
        assert 0.78 < near_dedup.set_similarity(a, b) < 0.84
        missed += not (sketch(a) == sketch(b)).any()
        c = np.concatenate([a[150:], a[:150]])
        kept_order += (sketch(a) == sketch(b)).sum()
        shuffled += (sketch(a) == sketch(c)).sum()
        assert not near_dedup.alike(a, c)[1]
    assert missed == 0
    far = random_.integers(0, 1 << 62, (200, 300), dtype=np.uint64)
    values = np.array([sketch(x) for x in far])
    assert len(np.unique(values)) == values.size


def test_occurrences_are_labelled():
    grams = np.array([7, 7, 9, 7], dtype=np.uint64)
    assert len(set(near_dedup.labelled(grams).tolist())) == 4


# secrets


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.name)
def test_trigram_queries_are_necessary(rule):
    query, samples = secret_scan.trigram_query(rule.pattern), {
        "assign": ["PassWord = 'abcdef", "api_key:xyz123=", "apikey=aaaaaa", "passwd=......", "toKen: abcdef"], "access": ["AKIA" + "Z9" * 8],
        "github": ["ghp_" + "a" * 36], "slack": ["xoxb-0123456789"], "google": ["AIza" + "x" * 35], "hex": ["0" * 24],
        "jwt": ["eyJabcdefgh.eyJabcdefgh.x"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
    }
    for s in samples[rule.name]:
        assert re.search(rule.pattern, s)
        low = s.lower()
        assert any(all(t in low for t in needed) for needed in query)
    assert (query == secret_scan.ANYTHING) == (rule.name == "hex")


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"(ab|cd?)ef{2,3}[gh]i*jk(lm){2}", fullmatch=True))
def test_trigram_query_of_a_general_rule(text):
    query = secret_scan.trigram_query(r"(ab|cd?)ef{2,3}[gh]i*jk(lm){2}")
    assert query != secret_scan.ANYTHING
    assert any(all(t in text for t in needed) for needed in query)


# quality


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#|é\x0b\x1c", max_size=120))
def test_counts(text):
    counts, features = Statistics()(text)
    assert tuple(counts) == plain_counts(text)[:5]
    assert len(features) == len(FEATURES) and np.isfinite(features).all()


def test_repeated_words_cover_overlaps():
    assert repeated_words([b"a"] * 6) == 6
    assert repeated_words([b"a"] * 5) == 0


def labelled_sample(n=3000, seed=0):
    r = np.random.default_rng(seed)
    x = r.random((n, len(FEATURES)))
    y = ((x[:, 2] < 0.6) & ((x[:, 9] > 0.3) ^ (x[:, 1] > 0.5))).astype(float)
    return x, y


def test_forest_learns_and_keeps_its_signs():
    x, y = labelled_sample()
    forest = quality_rules.fit_forest(x, y, quality_rules.signs(), trees=120, depth=4)
    other, truth = labelled_sample(seed=1)
    assert ((forest.score(other) >= 0.5) == truth).mean() > 0.93
    for name in quality_rules.FALLING:
        f = FEATURES.index(name)
        steps = np.repeat(other[:50, None, :], 40, axis=1)
        steps[:, :, f] = np.linspace(0, 1, 40)
        scores = forest.score(steps.reshape(-1, len(FEATURES))).reshape(50, 40)
        assert (np.diff(scores, axis=1) <= 1e-12).all()


def test_additive_model_needs_its_pairs():
    x, y = labelled_sample()
    other, truth = labelled_sample(seed=1)
    full, plain = quality_gam.fit_additive(x, y), quality_gam.fit_additive(x, y, pairs=0)
    accuracy = [((m.score(other) >= 0.5) == truth).mean() for m in (full, plain)]
    assert accuracy[0] > 0.93 > accuracy[1]
    assert (1, 9) in full.pairs


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(5), np.zeros(5)])
def test_one_kind_of_label(y):
    x = np.zeros((len(y), len(FEATURES)))
    expected = 1.0 if not len(y) or y[0] else 0.0
    assert np.allclose(quality_rules.fit_forest(x, y, quality_rules.signs()).score(np.zeros((2, len(FEATURES)))), expected, atol=1e-6)
    assert np.isfinite(quality_gam.fit_additive(x, y).score(np.zeros((2, len(FEATURES))))).all()


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<script>if(a<b){'</p>'}</script><p>x", "x"), ("<p>a<br>b</p>", "a b"),
        ("<article><p>a &lt;b&gt; &amp;amp;</p></article>", "a <b> &amp;"), ("<p>x<a href='q>r'>y</a>z", "xyz"), ("<p>a  \n b&nbsp;c</p>", "a b c"),
        ("<nav>menu</nav><div class='ad'>buy, buy, buy.</div><article><h1>T</h1><p>Short.</p></article><footer>f</footer>", "T\n\nShort."),
        ("<body><aside>s</aside><div id=content><h2>T</h2><p>A sentence, with words.</p><ul><li>i</li><li>j</li></ul></div>"
         "<div class='comments'><p>Nice, very nice, well done.</p></div><form>f</form>", "T\n\nA sentence, with words.\n\ni\n\nj"),
        ("<article><header><h1>T</h1></header><p>a.</p><section class='reader-comments'><p>no.</p></section></article>", "T\n\na."),
        ("<article><p>unclosed <b>bold", "unclosed bold"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<p title=\"a>b\">t</p>", "t"),
        ("<article><table><tr><td>x<td>y</table></article>", "x\n\ny"), ("<nav>only</nav>", ""), ("<", "<"), ("a < b", "a < b"),
        ("<div class='cookie-notice'>c.</div><main><p>m.</p></main>", "m."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PROSE = "This is a sentence of the article, with enough words to read like one."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *[(f"<div class='content {c}'><article><h1>T</h1><p>{PROSE}</p></article></div>", f"T\n\n{PROSE}")
          for c in ("has-sidebar", "with-sidebar", "no-sidebar", "sidebar", "sidebar-left")],
        *[(f"<div class='content {c}'><h1>T</h1><p>{PROSE}</p></div>", f"T\n\n{PROSE}") for c in ("has-sidebar", "sidebar-left")],
        (f"<div class='sidebar-left'><p>{PROSE}</p><ul class='related'>" + "<li><a href='x'>x</a></li>" * 20 + "</ul></div>", PROSE),
        ("<div class='content sidebar-left'><p>Short.</p></div>", "Short."),
        (f"<article><p>{PROSE}</p><h3 id='share-prices'>S</h3><p>Up.</p></article>", f"{PROSE}\n\nS\n\nUp."),
        *[(f"<article><p>{PROSE}</p><section id='{i}'><p>Up.</p></section></article>", f"{PROSE}\n\nUp.") for i in ("related-work", "search-results")],
        (f"<article><div class='post-header'><h1>T</h1></div><p>{PROSE}</p></article>", f"T\n\n{PROSE}"),
        (f"<article><div class='share-prices'><p>{PROSE}</p></div><p>{PROSE}</p></article>", f"{PROSE}\n\n{PROSE}"),
        # by name and evidence
        (f"<article><p>{PROSE}</p><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div></article>", f"{PROSE}\n\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class='share'><a href='x'>Share it</a></div></article>", PROSE),
        (f"<div class='related'><article><a href='x'>Card</a></article></div><article><p>{PROSE}</p></article>", PROSE),
        (f"<div class='has-sidebar'><p>{PROSE}</p><div class='sidebar'><a href='x'>more</a></div></div>", PROSE),
    ],
)
def test_names_condemn_by_evidence_only(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", "If x=1 holds."),
        ("<p>a <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> b", "a x b"),
        ("<article><p>a</p><object data='x'><p>In words.</p></object><canvas>A chart.</canvas></article>", "a\n\nIn words.\n\nA chart."),
        *[(f"<article><p>a</p><{e}><p>b</p></article><p>c", "a\n\nb") for e in ("svg", "select", "object", "canvas", "noscript", "template", "math")],
        ("<article><p>a</p><svg><g><text>no</text><p>b</p></article><p>c<svg></svg>", "a\n\nb"),
        ("<article><div>a<select><option>no</div><p>b</p></article><select></select>", "a\n\nb"),
        ("<p>a<svg><title>t</title><text>no</text></svg>b<select><option>no</select>c", "a b c"),
        ("<p>a<noscript><p>no</p></noscript>b<template><div>no</div></template>c</p>", "abc"),
        ("<article><p>a</p><template><template><p>no</p></template><p>no</p></template><p>b</p></article>", "a\n\nb"),
        ("<p>a<iframe><p>no</p></iframe>b<textarea><p>no</textarea>c", "abc"),
    ],
)
def test_only_raw_text_is_skipped(page, text):
    assert html_text.main_text(page) == text


def test_hostile_markup_takes_linear_time():
    for page in ("<a " * 50_000, "<p " + "x='" * 50_000, "<div>" * 5_000 + "t", "<!--" * 50_000, "<p a=\"" * 20_000):
        html_text.main_text(page)


# vectors


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 1000))
def test_segment_bounds(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.integers(-64, 64, (n, d)).astype(float)
    truth = x @ x.T
    for s in (1, 2, 3, 8):
        stats = vector_search.statistics(x, s)
        assert (stats @ stats.T >= truth - 1e-6).all()


@pytest.mark.parametrize("spread", [1, 3, 200])
def test_best_in_block(spread):
    r = np.random.default_rng(spread)
    rows, ids = r.integers(-spread, spread + 1, (500, 64)).astype(float), r.permutation(1000)[:500]
    rows[100:350] = rows[0]  # a group of equal vectors
    q_ids, vec, score = vector_search.best_in_block(ids[:20], rows[:20], ids, rows)
    for i in range(20):
        full = sorted((-int(rows[i] @ rows[j]), int(ids[j])) for j in range(500) if ids[j] != ids[i])[:20]
        mine = q_ids == ids[i]
        assert sorted(zip((-score[mine]).tolist(), vec[mine].tolist())) == full


def test_large_components_stay_exact():
    big = float(1 << 30)
    assert vector_search.exact(np.array([big, 1.0]), np.array([[big, 1.0], [big, 2.0]])).tolist() == [(1 << 60) + 1, (1 << 60) + 2]


def test_vector_scores_near_the_edge_of_doubles():
    r = random.Random(7)
    for bits in (20, 23, 24, 26, 31, 62):
        rows = np.array([[float(r.randrange(-(1 << bits), 1 << bits)) for _ in range(128)] for _ in range(12)])
        plain = [sum(int(a) * int(b) for a, b in zip(rows[0], x)) for x in rows]
        assert vector_search.exact(rows[0], rows).tolist() == [min(max(v, -(1 << 63)), (1 << 63) - 1) for v in plain]
    ids = np.arange(300)
    rows = np.array([[float(r.randrange(-(1 << 24), 1 << 24)) for _ in range(64)] for _ in ids])
    q_ids, vec, score = vector_search.best_in_block(ids[:5], rows[:5], ids, rows, 7)
    for q in range(5):
        plain = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q], rows[c])), c) for c in range(300) if c != q)[:7]
        assert sorted(zip((-score[q_ids == q]).tolist(), vec[q_ids == q].tolist())) == plain


def test_scores_beyond_64_bits_keep_the_best_rows():
    ids = np.arange(60)
    rows = np.ones((60, 4))
    rows[0], rows[1:31, 0] = [float(1 << 40), 1.0, 1.0, 1.0], -float(1 << 40)  # 30 products below the least of 64 bits
    _, vec, score = vector_search.best_in_block(ids[:1], rows[:1], ids, rows)
    assert sorted(vec.tolist()) == list(range(31, 51)) and set(score.tolist()) == {(1 << 40) + 3}


def test_components_beyond_64_bits(spark):
    far = spark.createDataFrame([(0, [2.0**70, 1.0]), (1, [-0.51, 2.0**-70]), (2, [-(2.0**70), 1.5])], "vec_id long, embedding array<double>")
    found = far.select(vector_search.quantised("embedding").alias("x")).collect()
    assert [r.x for r in found] == [[2.0**76, 64.0], [-33.0, 0.0], [-(2.0**76), 96.0]]


def test_patterns_are_the_published_ones():
    assert bpe.PATTERN == public_tokenizers.PATTERN and regex.compile(bpe.PATTERN)


PROSE = " ".join(["This is a long sentence, with words; and more words in it."] * 6)


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=f><div class=nav><a href=x>Home</a> <a href=y>News</a></div><article><h1>T</h1><p>{PROSE}</p></article></form></body>", f"T\n\n{PROSE}"),
    (f"<html><body><form><div><h1>T</h1><p id=p1>{PROSE}</p><p id=p2>{PROSE}</p></div></form></body></html>", f"T\n\n{PROSE}\n\n{PROSE}"),
    (f"<body><fieldset><p>{PROSE}</p><p>{PROSE}</p></fieldset></body>", f"{PROSE}\n\n{PROSE}"),
    (f"<body style='display:none'><article><p>{PROSE}</p></article></body>", PROSE),
    (f"<body><div hidden><main><p>{PROSE}</p></main></div><div hidden>{PROSE}</div></body>", PROSE),
    (f"<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE}\n\n{PROSE}"),
    (f"<article><p>{PROSE}</p><form><p>Name</p><p>Your comment</p></form></article>", PROSE),
])
def test_articles_inside_forms_and_hidden_parts(page, text):
    assert html_text.main_text(page) == text


def test_ids_make_no_paths():
    found = html_text.blocks(f"<body><div><p id=p1>{PROSE}</p><p id=p2 class=x>{PROSE}</p><p class=y>a</p><p class=y>b</p></div></body>")
    assert [b.path[-1] for b in found] == ["p", "p", "p.y", "p.y"]
    sums = html_text.path_sums(found)
    assert sums[found[0].path][0] == 2 and sums[found[2].path][1] == 2.0


def test_fused_scores_by_hand():
    found = html_text.blocks(f"<body><p>{PROSE}</p><p>{PROSE}</p><h2>Title</h2><div><a href=x>Home</a> go</div></body>")
    sums = html_text.path_sums(found)
    length = [len(PROSE), len(PROSE), 5, 3]
    marks = [1 / 2 + 18, 1 / 2 + 18, 1, 1]

    def smoothed(v):
        at = [v[0], *v, v[-1]]
        return [0.25 * at[i] + 0.5 * at[i + 1] + 0.25 * at[i + 2] for i in range(len(v))]

    expected = [a * b for a, b in zip(smoothed(length), smoothed(marks))]
    assert html_text.fused_scores(found, sums).tolist() == pytest.approx(expected)


def test_scores_decide_what_a_suspect_is(monkeypatch):
    page = f"<body><div class=content><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>Menu one</p><p>two</p></div></body>"
    assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE}"
    monkeypatch.setattr(html_text, "fused_scores", lambda found, sums: np.full(len(found), 1000.0))
    assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE}\n\nMenu one\n\ntwo"
