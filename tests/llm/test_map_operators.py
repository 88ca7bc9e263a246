"""Extraction, language, toxicity and tokens: operators that work text by text."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import bpe, html_extract, langid, toxicity

from .conftest import EDGES, documents


def test_html_keeps_the_article_and_leaves_the_rest():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>
    text of some length here</p><div class='ad'>buy</div><p>Second one, as long as it is<br>and on</p></article><aside>more</aside>
    <section id="comments"><p>nice nice nice nice</p></section><footer>&copy; 2024</footer></body></html>"""
    assert html_extract.extract(page) == "A & B\nFirst bold text of some length here\nSecond one, as long as it is and on"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"), ("<p>cut <b>off", "cut off"), ("<script>x", ""), ("<nav>a b</nav>", ""), ("<p>a</p", "a"), ("<p>1 &lt; 2 &#233;", "1 < 2 é")])
def test_html_edges(page, text):
    assert html_extract.extract(page) == text


def test_region_is_the_best_contiguous_run():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        a, z = html_extract.region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:z]) == best


@pytest.mark.parametrize("shell", ["article", 'div class="content"'])
@pytest.mark.parametrize("inner", ["<aside><p>{}</p></aside>", '<div class="ad">{}</div>', "<form><label>{}</label><input name=q></form>"])
def test_html_long_adverts_inside_an_article_cut_nothing(shell, inner):
    first, last = " ".join(["first"] * 25), " ".join(["last"] * 60)
    page = f"<body><nav>menu here</nav><{shell}><h1>Some heading</h1><p>{first}</p>{inner.format('advert ' * 90)}<p>{last}</p></{shell.split()[0]}><footer>end</footer></body>"
    assert html_extract.extract(page) == f"Some heading\n{first}\n{last}"


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(rows).collect())
    assert got == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_extract.main_text(rows.filter("page_id > 5")).count() == 0


def test_pages_match_their_articles(spark, sf):
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert html_extract.extract(r.html) == "\n".join(b for b in blocks if b)


def test_bpe_round_trip_by_any_chunks():
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    rng = random.Random(2)
    alphabet = "aé1 \n\t ' 'sll.,!ß中"
    for _ in range(800):
        text = "".join(rng.choice(alphabet[: rng.randint(2, len(alphabet))]) for _ in range(rng.randint(0, 150)))
        want = np.array(c.encoding.encode_ordinary(text), "<u4").tobytes()
        assert c.encode(text, rng.randint(3, 25), rng.randint(1, 12)) == want
        assert c.decode(want) == text.encode()


def test_bpe_grows_only_as_far_as_needed():
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    words = "".join(f"word{i} and more, " for i in range(4_000))
    text = words + "x" * 3_000 + " " + words
    seen = []
    plain = c.boundaries
    c.boundaries = lambda t: seen.append(len(t)) or plain(t)
    try:
        got = c.encode(text, 1_000, 100)
    finally:
        c.boundaries = plain
    assert got == np.array(c.encoding.encode_ordinary(text), "<u4").tobytes()
    assert max(seen) <= 10_000 < len(text)


def test_registered_bpe_equals_the_library(spark, sf):
    import hashlib

    from gradeloom.llm import queries

    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_bpe"](spark, sf).collect():
        ids = np.array(c.encoding.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_dealt_chunks_equal_whole_texts(edge_docs):
    near = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.encode(edge_docs, long_chars=10**9).collect()}
    far = bpe.encode(edge_docs, long_chars=20, chunk_chars=1000, overlap_chars=40).collect()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in far} == near and len(far) == len(EDGES)
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in EDGES)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in far) == want
    decoded = bpe.decode(bpe.encode(edge_docs)).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for _, t, *_ in EDGES)


def test_bpe_empty_table(no_docs):
    assert bpe.encode(no_docs).count() == 0


def test_language_is_held_out_accurate(spark, sf):
    got = langid.op7(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the and with of it {i}", "en", "a") for i in range(600)] + [(1000 + i, f"der und mit von es {i}", "de", "a") for i in range(6)]
    docs = documents(spark, rows)
    model = langid.train(docs, F.lit(True), sample=60, least=6)
    assert model.languages == ["de", "en"] and model.predict("und der mit es")[0] == "de"


def test_optimiser_equals_plain_loops():
    """The same updates, one coordinate at a time."""
    rng = random.Random(4)
    rows = [(lang, *langid.features(" ".join(rng.choice(words) for _ in range(4)), 64)) for _ in range(6) for lang, words in (("en", ["the", "and"]), ("de", ["der", "und"]), ("fr", ["le", "et"]))]
    model = langid.fit(rows, 64, epochs=2)
    names, alpha, beta, l1, l2 = ["de", "en", "fr"], 0.5, 1.0, 0.02, 0.02
    z, n = ({(k, j): 0.0 for k in [*range(64), "b"] for j in range(3)} for _ in range(2))
    weight = lambda k, j: 0.0 if abs(z[k, j]) <= (0.0 if k == "b" else l1) else (np.sign(z[k, j]) * (0.0 if k == "b" else l1) - z[k, j]) / ((beta + n[k, j] ** 0.5) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            lang, where, counts = rows[i]
            x = [*zip(where.tolist(), model.vector(where, counts).tolist(), strict=True), ("b", 1.0)]
            w = {(k, j): weight(k, j) for k, _ in x for j in range(3)}
            logits = [sum(v * w[k, j] for k, v in x) for j in range(3)]
            p = np.exp(np.array(logits) - max(logits))
            p /= p.sum()
            for k, v in x:
                for j in range(3):
                    g = (p[j] - (names[j] == lang)) * v
                    sigma = ((n[k, j] + g * g) ** 0.5 - n[k, j] ** 0.5) / alpha
                    z[k, j] += g - sigma * w[k, j]
                    n[k, j] += g * g
    assert np.allclose(model.weights, [[weight(k, j) for j in range(3)] for k in range(64)]) and np.allclose(model.bias, [weight("b", j) for j in range(3)])


def test_ties_go_to_the_first_language():
    model = langid.Model(["de", "en"], np.ones(64), np.zeros((64, 2)), np.zeros(2), 1.0)
    assert model.predict("anything") == ("de", 0.5)


def test_language_edges(spark, edge_docs, no_docs):
    model = langid.train(edge_docs, F.lit(True))
    got = langid.predict(edge_docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert langid.accepted(edge_docs, model, 0.0).columns == edge_docs.columns
    empty = langid.train(no_docs, F.lit(True))
    assert langid.predict(no_docs, empty).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(documents(spark, EDGES[:1]), empty).collect()} == {("und", 0.0)}


def test_weights_are_sparse():
    rng = random.Random(1)
    rows = [(lang, *langid.features(" ".join(rng.choice(words) for _ in range(30)))) for _ in range(60) for lang, words in (("en", ["the", "and", "with"]), ("de", ["der", "und", "mit"]))]
    model = langid.fit(rows)
    assert model.predict("the and with the")[0] == "en" and model.predict("der und mit der")[0] == "de"
    assert (model.weights != 0).mean() < 0.05


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    plain = ["sun", "rain", "tree", "road", "house", "river", "bread", "stone"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) + rng.choice("abcdef") for _ in range(40)]
        if i % 4 == 0:
            words[5:8] = [rng.choice(["vile", "nasty", "awful"])] * 3
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    return toxicity.train(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)), dict(rows and [(r[0], r[1]) for r in rows])


def dense(model, text):
    out = np.zeros(len(model.vocabulary))
    at, v = model.vector(text)
    out[at] = v
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_toxic_neighbours_are_those_of_a_full_scan(index, block):
    import copy

    model, texts = copy.copy(index[0]), index[1]
    model.__dict__ = {k: v for k, v in model.__dict__.items() if k[0] != "_"} | {"block": block}
    every = np.stack([dense(model, texts[int(i)]) for i in model.ids])
    asked = [*list(texts.values())[:80], "vile", "nothing known", "", "suna suna raina"]
    for text, got in zip(asked, model.nearest([model.vector(t) for t in asked]), strict=True):
        cosines = np.round(every @ dense(model, text), 9)
        want = sorted((-c, int(i)) for c, i in zip(cosines, model.ids, strict=True) if c > 0)[: model.k]
        assert [(-c, int(model.ids[i])) for c, i in got] == [(pytest.approx(c), i) for c, i in want]


def test_vocabulary_has_every_term_and_votes_are_weighted(index):
    model, texts = index
    assert set().union(*(toxicity.term_counts(t)[0].tolist() for t in texts.values())) == set(model.vocabulary.tolist())
    near = model.nearest([model.vector("vile road")])[0]
    w = [(1.05 - c) ** -2 for c, _ in near]
    rest = model.k * (1.05 - toxicity.FAR) ** -2
    want = (sum(x * model.labels[i] for x, (_, i) in zip(w, near, strict=True)) + rest * model.alone) / (sum(w) + rest)
    assert model.vote(near) == pytest.approx(want)
    assert model.score("vile road")[0] == pytest.approx(toxicity.calibrated(want, model.curve))


def test_registered_toxicity_is_held_out_accurate(spark):
    from gradeloom.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op5_toxicity"](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    loss = -np.mean([np.log(max(1e-9, r.score if labels[r.doc_id] else 1 - r.score)) for r in held])
    share = np.mean([labels[r.doc_id] for r in held])
    assert loss < -(share * np.log(share) + (1 - share) * np.log(1 - share))  # better than the share alone


def test_rare_labels_are_sampled(spark):
    rows = [(i, "zork here" if i < 3 else f"calm words{i % 7}", "en", "a") for i in range(400)]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame([(i, int(i < 3)) for i in range(400)] * 2, "doc_id long, toxic int"), F.lit(True), sample=40)
    assert {0, 1, 2} <= set(model.ids.tolist()) and len(model.ids) <= 40 and model.alone < 0.05


def test_toxicity_scores(spark, index, edge_docs):
    model, _ = index
    assert model.score("a vile vile vile thing")[0] > 0.5 > model.score("a sunny road")[0]
    assert model.score("")[0] == model.alone
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.accepted(edge_docs, model).columns == edge_docs.columns


def test_terms_are_words_beginnings_and_marks():
    from collections import Counter

    texts = ["The cat the CAT sat, Straße ÉCOLE écoles! x1y", "no-one's here: Bücherei Bücher", "", "123 ... !", "中文字 mixed中文 letters", "a" * 5000]
    names: dict = {}
    for text in texts:
        want: Counter = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            want[w] += 1
            if len(w) >= 5:
                want[w[:5] + "*"] += 1
        terms, counts = toxicity.terms_in(text)
        assert sorted(counts.tolist()) == sorted(want.values())
        for w, n in want.items():
            one = set(toxicity.terms_in(w.rstrip("*"))[0].tolist()) if not w.endswith("*") else set(toxicity.terms_in(w[:-1] + "zz")[0].tolist()) - set(toxicity.terms_in("zz")[0].tolist())
            assert any(t in one and c == n for t, c in zip(terms.tolist(), counts.tolist(), strict=True)), w
        names[text] = len(terms)


def test_toxic_words_of_few_examples_count(spark):
    rows = [(i, f"plain words{i % 4} here " + ("zork" if i < 5 else "calm"), "en", "a") for i in range(20)]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame([(i, int(i < 5)) for i in range(20)], "doc_id long, toxic int"), F.lit(True))
    assert set(toxicity.term_counts("zork calm")[0].tolist()) <= set(model.vocabulary.tolist())
    assert model.score("such a zork")[0] > 0.5 > model.score("such a calm")[0]


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge_docs, none, F.lit(True))
    assert {r.score for r in toxicity.score(edge_docs, model).collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0


def plain_grams(text, buckets):
    """Buckets of a text's character 1- to 3-grams, one gram at a time, in whole numbers of 64 bits."""
    out, codes, top = {}, [ord(c) for c in text.lower()], 64 - (buckets - 1).bit_length()
    for i in range(len(codes)):
        h = codes[i] * 0x9E3779B97F4A7C15 % 2**64
        for n in (1, 2, 3):
            if n > 1:
                if i + n > len(codes):
                    break
                h = ((h ^ n) * 0xBF58476D1CE4E5B9 + codes[i + n - 1] * 0x94D049BB133111EB) % 2**64
            out[h >> top] = out.get(h >> top, 0) + 1
    return out


def test_language_query_equals_loops(spark, sf):
    """Features, weights of rarity, prediction, score and temperature of every row of the query, from the trained weights alone."""
    import math
    import zlib

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    learned = {(i, t): lang for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None and any(c.isalpha() for c in t)}
    df = {}
    for _, t in learned:
        for b in plain_grams(t, langid.BUCKETS):
            df[b] = df.get(b, 0) + 1
    idf = lambda b: math.log((1 + len(learned)) / (1 + df.get(b, 0))) + 1
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(frame.select("doc_id", "text", "lang"), langid.crc_fold("doc_id", 4) != 2)
    assert model.languages == sorted(set(learned.values()))
    got = {r.doc_id: r for r in langid.op7(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs[:60]:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 1.0)
            continue
        x = {b: math.log1p(n) * idf(b) for b, n in plain_grams(t, langid.BUCKETS).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[b][k] for b, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=lambda k: (p[k], -k))
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(p[best] / sum(p), abs=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
