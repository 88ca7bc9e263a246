"""Fingerprints, search, joins, language model, shards and mixes: operators that move rows, against brute force."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import brown_lm, fingerprints, jaccard, mixing, sharding, topk
from gradeloom.llm.shared import crc_fold, word_hashes

from .conftest import EDGES, documents


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Fingerprints


def test_canonical_forms(spark):
    same = [["Straße  über\nﬁn", " STRASSE über fin "], ["é", "é"], ["①", "1"], ["a b", "A b"]]
    rows = spark.createDataFrame([(10 * i + j, t) for i, g in enumerate(same) for j, t in enumerate(g)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprinted(rows).collect()}
    assert all(got[10 * i] == got[10 * i + 1] for i in range(len(same))) and len(set(got.values())) == len(same)


@pytest.mark.parametrize("bits, rows", [(64, 5_000), (64, 2), (2, 3)])
def test_fingerprints_of_edges(edge_docs, monkeypatch, bits, rows):
    import hashlib

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    got = fingerprints.compared(edge_docs, bits).collect()
    assert len(got) == len(EDGES)
    ordered = sorted(EDGES, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in ordered]
    known = {r[0]: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for r, t, n in zip(ordered, texts, [*texts[1:], texts[0]], strict=True) if r[0] is not None and r[0] not in (1, 2)}
    assert all(r.edited_sha256 == known[r.doc_id] for r in got if r.doc_id in known)
    by_text = collections.defaultdict(set)
    texts_of = {r[0]: r[1] for r in EDGES if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[" ".join((texts_of[r.doc_id] or "").lower().split())].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert all(r.near_edited in (0.0, 1.0) and r.near_next in (0.0, 1.0) for r in got)


def brute_fingerprints(docs):
    """edited_sha256, canonical forms' likeness, from Python's own Unicode tables; docs: id and text, ids distinct."""
    import hashlib
    import unicodedata

    form = lambda t: " ".join(re.split(r"[\s\x1c-\x1f\x85]+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))).strip()
    ordered = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(edited) == form(t)), float(form(n) == form(t)), form(t), form(edited))
    return out


def test_registered_fingerprints_equal_brute_force(spark, sf):
    from gradeloom.llm import queries

    want = brute_fingerprints([(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    rows = queries.QUERIES["op2_fingerprints"](spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == {i: w[:4] for i, w in want.items()}
    forms = {}
    for r in rows:
        assert forms.setdefault(r.fingerprint, want[r.doc_id][4]) == want[r.doc_id][4]
        assert forms.setdefault(r.edited_fingerprint, want[r.doc_id][5]) == want[r.doc_id][5]
    assert len(set(forms.values())) == len(forms)


@pytest.mark.parametrize("hot", [3, None])
def test_hot_ids_are_cut(spark, monkeypatch, hot):
    """One id has most rows, with many texts, one of which stands very often: each row's next one still follows it in falling order of id and rising hash."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rows = [(i, f"text {i} alone") for i in range(12)] + [(hot, f"hot {j % 40} words") for j in range(120)] + [(hot, "same same same")] * 60
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4)
    whole = fingerprints.digested(fingerprints.whole(docs)).withColumn("__h", F.xxhash64("text"))
    got = fingerprints.with_next(whole, ("__a",)).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = collections.Counter((i, t, n) for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True))
    assert collections.Counter((r.doc_id, r.text, r.next_text) for r in got) == want


def test_fingerprints_of_no_rows_and_of_one(spark, no_docs):
    assert fingerprints.compared(no_docs).count() == 0
    r = fingerprints.compared(documents(spark, EDGES[:1])).first()
    assert r.near_next == 1.0 and r.n_chars == len(EDGES[0][1])


def test_fingerprint_plan_is_native(edge_docs):
    plan = fingerprints.compared(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))


def by_sql(folder_or_rows):
    con = duckdb.connect()
    if isinstance(folder_or_rows, str):
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder_or_rows}/embeddings.parquet'")
    else:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", folder_or_rows)
    return sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP3_SQL})").fetchall())


def test_search_equals_sql(spark, sf):
    want = by_sql(sf)
    assert sorted(map(tuple, topk.op3(spark, sf).collect())) == want
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, shard_rows=60, leaf_rows=7).collect())) == want


@pytest.mark.parametrize("shard_rows", [16_384, 3])
def test_search_edges_equal_sql(spark, shard_rows):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [5.0, 5.0]), (7, [-1.0, 0.5]), (8, []), (9, [1.0]), (20, [0.0, 0.0]), (20, [1e7, -1e7])]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, leaf_rows=2).collect()))
    assert got == by_sql(rows) and {r[2] for r in got} == {0, 1, 2, 7, 8, 9, 20}
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_many_repeated_rows(spark):
    rows = [(20, [0.5, 0.25])] * 30 + [(i, [0.5, i / 8]) for i in range(40)]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=16, leaf_rows=4).collect()))
    assert got == by_sql(rows)


def test_components_beyond_floats_are_exact(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 1.0]), (2, [1.0, 1.0]), (3, [3e7, 3e7]), (20, [3e7, 3e7]), (4, [3e7, 2.9999998e7])] + [(10 * i + 5, [float(i), -float(i)]) for i in range(50)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3, shard_rows=20, leaf_rows=4).collect()
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for q in (0, 20):
        mine = dict(whole)[q]
        want = sorted((-min((1 << 63) - 1, sum(a * b for a, b in zip(mine, v, strict=True))), i) for i, v in whole if i != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in want]


def test_traversal_starts_at_the_root_and_skips_subtrees():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(-3, 4, (4_000, 6)), rng.integers(50, 60, (60, 6))]).astype(float)
    ids = np.arange(len(points))
    tree = topk.Tree(points, ids, ids).build(16)
    for node, (left, right) in enumerate(tree.children):
        if left >= 0:  # tight boxes nest
            assert (tree.low[node] == np.minimum(tree.low[left], tree.low[right])).all() and (tree.high[node] == np.maximum(tree.high[left], tree.high[right])).all()
    queries = rng.integers(1, 9, (40, 6)).astype(float)
    got = tree.search(queries, np.full(40, -1), [None] * 40, 5)
    scores = queries @ points.T
    for s, found in zip(scores, got, strict=True):
        assert found == [(int(-x), int(i)) for x, i in sorted(zip(-s, ids, strict=True))[:5]]
    leaves = sum(left < 0 for left, _ in tree.children)
    assert tree.scored < 40 * leaves / 10 and tree.opened < 40 * len(tree.children) / 5
    before = tree.opened
    assert tree.search(queries, np.full(40, -1), [10**6] * 40, 5) == [[] for _ in range(40)] and tree.opened == before


# Similarity join


def brute_classes(texts):
    grams = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (split((t or "").lower()) for t in texts)]
    links, parent = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if grams[i] and grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [256, 3])
def test_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            words[k] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.integers(0, 50)}" for _ in range(30)) for _ in range(20)] + ["a b", "a b", "a b c", "", None, " "] + texts[:3]
    links, roots = brute_classes(texts)
    got = sorted(jaccard.classes(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), block=block).collect())
    assert [r.n_links for r in got] == links
    assert [r.class_id for r in got] == roots


def test_join_edges(spark, edge_docs, no_docs):
    got = jaccard.classes(edge_docs).collect()
    assert len(got) == len(EDGES)
    assert sorted((r.class_id, r.n_links) for r in got if r.doc_id in (1, 2)) == [(1, 2)] * 3
    assert {(r.class_id, r.n_links) for r in got if r.doc_id in (3, 4, 5)} == {(3, 0), (4, 0), (5, 0)}
    assert jaccard.classes(no_docs).count() == 0 and jaccard.one_each(no_docs).count() == 0
    kept = jaccard.one_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "None", "7", "8", "9", "10", "11"])


def test_registered_join_meets_every_true_pair_of_the_query_set(spark):
    """Documents whose id is divisible by 100 against all rows: their links by brute force on the full sets."""
    from gradeloom.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: set(jaccard.grams(t or "").tolist()) for i, t in texts.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_jaccard_join"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    met = true = 0
    for q in [i for i in texts if i % 100 == 0] + [i for i, r in got.items() if r.n_links][:40]:
        links = [i for i, s in sets.items() if i != q and s and sets[q] and 5 * len(s & sets[q]) >= 4 * len(s | sets[q])]
        true += len(links)
        met += got[q].n_links
        assert got[q].n_links <= len(links) and all(got[i].class_id == got[q].class_id for i in links)
    assert true and met / true >= 0.999


def test_repeated_rows_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "en", "a")] * 4 + [(3, text + " more", "en", "a"), (None, text, "en", "a"), (5, "other words here", "en", "a"), (5, "other words here", "de", "b"), (6, "", "en", "a"), (6, "", "en", "a")]
    kept = jaccard.one_each(documents(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) in ([("3", text), ("5", "other words here")], [("3", text + " more"), ("5", "other words here")])
    assert sum(r.doc_id == 6 for r in kept) == 2


def test_bands_reach_their_recall():
    b = jaccard.bands_for(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("a", "b"), ("b", "c"), ("a", "a")], "a string, b string")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert {got[f"{i:03d}"] for i in range(1, 41)} == {"000"} and got["b"] == got["c"] == "a"


# Language model


def brute_base(docs, held):
    low = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
    tokens = [[*split((t or "").translate(low)), None] for t in docs]
    counts = collections.Counter(w for k, h in zip(tokens, held, strict=True) if not h for w in k)
    total = sum(counts.values())
    score = [sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in k) for k in tokens]
    return [(len(k), sum(counts[w] > 0 for w in k), total) for k in tokens], score


def test_word_hashes_tell_words_apart():
    text = "The the THE cat\x0bcat x é É ab ba " + " ".join(f"k{i}" for i in range(5000))
    low = [w.translate(str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})) for w in split(text)]
    h = word_hashes(text).tolist()
    assert len(h) == len(low) and len(set(h)) == len(set(low)) and len(set(zip(h, low, strict=True))) == len(set(low))
    odd = "".join("ab"[i.bit_count() % 2] for i in range(2048))  # the Thue-Morse word and its mirror, which polynomials modulo 2**64 can't tell apart
    a, b, c = word_hashes(f"{odd} {odd.translate(str.maketrans('ab', 'ba'))} {odd}")
    assert a == c != b


def test_language_model_beats_unigrams(spark, sf):
    got = brown_lm.op6(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in got]
    counts, base = brute_base([r.text for r in got], held)
    assert [r.held_out for r in got] == held
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == counts
    assert np.allclose([r.base_score for r in got], base, rtol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 8])
def test_rare_words_by_join_equal_words_in_place(spark, edge_docs, monkeypatch, bits):
    monkeypatch.setattr(brown_lm, "BITS", bits)
    a, b = ({}, {})
    for out, head in ((a, 65_536), (b, 6)):
        model, words = brown_lm.train(edge_docs, F.lit(True), own=3, head=head, least=1)
        out.update(((r.doc_id, r.n_tokens), (r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in brown_lm.score(edge_docs, model, words).collect())
    assert a == b


def test_language_model_edges(spark, edge_docs, no_docs):
    model, words = brown_lm.train(edge_docs, F.lit(False))
    got = brown_lm.score(edge_docs, model, words).collect()
    assert len(got) == len(EDGES) and all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in got)
    model, words = brown_lm.train(no_docs, F.lit(True))
    assert brown_lm.score(no_docs, model, words).count() == 0
    held = crc_fold("doc_id", 5) == 1
    model, words = brown_lm.train(edge_docs, ~held)
    tokens, base = brute_base([r[1] for r in EDGES], [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 1 for r in EDGES])
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown_lm.score(edge_docs, model, words).collect())
    assert got == sorted((*t, round(b, 6)) for t, b in zip(tokens, base, strict=True))


@pytest.mark.parametrize("head", [1 << 19, 700])
def test_scores_equal_brute_force(spark, sf, head):
    """The score of every text, from its words' classes, with all counts of classes made again here."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, words = brown_lm.train(docs, crc_fold("doc_id", 5) != 1, own=100, head=head)
    rows = docs.collect()
    chosen = {r.w: r.k for r in words.classes.collect()}
    lookup = model.lookup
    in_place = dict(zip(lookup.words.tolist(), lookup.class_of.tolist(), strict=True))
    lines = []
    for r in rows:
        h, g, _ = brown_lm.tokens_of([r.text])
        lines.append([(w, in_place.get(w, chosen.get(w, int(lookup.group[x])))) for w, x in zip(h.tolist(), g.tolist(), strict=True)] + [(None, lookup.end)])
    train = [x for r, x in zip(rows, lines, strict=True) if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    count = collections.Counter(w for x in train for w, _ in x)
    assert all(chosen.keys() >= {w} or n < brown_lm.LEAST or w is None or w in in_place for w, n in count.items())
    k = len(model.spread)
    size, kinds = [0.0] * k, [0] * k
    seen = {}
    for x in train:
        for w, c in x:
            size[c] += 1
            seen[w] = c
    for c in seen.values():
        kinds[c] += 1
    pairs = collections.Counter((a, b) for x in train for (_, a), (_, b) in zip([(None, lookup.end), *x], x))
    out = collections.Counter()
    for (a, _), n in pairs.items():
        out[a] += n
    total = sum(size) + 0.5 * k
    got = {r.doc_id: r.score for r in brown_lm.score(docs, model, words).collect()}
    for r, x in zip(rows, lines, strict=True):
        want, before = 0.0, lookup.end
        for w, c in x:
            share = (size[c] + 0.5) / total
            want += math.log10((pairs[before, c] + brown_lm.KAPPA * share) / (out[before] + brown_lm.KAPPA)) + math.log10((count[w] + 0.5) / (size[c] + 0.5 * (kinds[c] + 1)))
            before = c
        assert got[r.doc_id] == pytest.approx(want, rel=1e-9)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((12, 12))
    for _ in range(3000):
        a = rng.integers(0, 12)
        pairs[a, (a % 2) * 6 + rng.integers(0, 6)] += 1  # what follows depends on the word's parity

    def likelihood(of):
        k = of.max() + 1
        hot = np.eye(k)[of]
        big = hot.T @ pairs @ hot
        return brown_lm.xlogx(big).sum() - brown_lm.xlogx(big.sum(0)).sum() - brown_lm.xlogx(big.sum(1)).sum()

    got = brown_lm.exchange(pairs, 4)
    assert likelihood(got) > max(likelihood(rng.integers(0, 4, 12)) for _ in range(20))


def test_words_beyond_the_own_ones_choose_their_classes(spark):
    texts = [f"a x{i}on b" for i in range(8)] * 4 + [f"c y{i}on d" for i in range(8)] * 4 + ["a p b", "c q d"] * 20
    asked = spark.createDataFrame([(0, "a x1on b"), (1, "a y1on b")], "doc_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    for head in (6, 65_536):
        model, words = brown_lm.train(docs, F.lit(True), own=6, classes=8, head=head)
        of = {r.w: r.k for r in words.classes.collect()}
        x, y = ({of[int(h)] for h in word_hashes(" ".join(f"{c}{i}on" for i in range(8))).view(np.int64)} for c in "xy")
        assert len(x) == len(y) == 1 and x != y
        like, unlike = brown_lm.score(asked, model, words).orderBy("doc_id").collect()
        assert like.base_score == unlike.base_score and like.score > unlike.score + 0.5


def test_choices_equal_brute_force():
    rng = np.random.default_rng(1)
    k, n = 5, 30
    now, between = rng.integers(0, k, n), rng.integers(0, 40, (k, k)).astype(float)
    found = rng.integers(0, 9, (n, 2 * k)) * (rng.random((n, 2 * k)) < 0.6)

    def with_word(big, w, b):
        out = big.copy()
        out[:, b] += found[w, :k]
        out[b, :] += found[w, k:]
        return out

    def likelihood(big):
        return brown_lm.xlogx(big).sum() - brown_lm.xlogx(big.sum(0)).sum() - brown_lm.xlogx(big.sum(1)).sum()

    for w in range(n):
        want = [likelihood(with_word(between, w, b)) for b in range(k)]
        assert brown_lm.choices(found[w : w + 1], now[w : w + 1], with_word(between, w, now[w]))[0] == np.argmax(want)


# Shards


def check_shards(rows, count=8):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(0 <= k < count for k in by)


def test_shards_balance(spark, sf):
    rows = sharding.op8(spark, sf).collect()
    check_shards(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    target = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - target) for s in sizes.values()) <= max(r.size for r in rows) + 0.02 * target
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.op8(spark, sf).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_of_edges(spark, edge_docs, no_docs):
    rows = sharding.shards(edge_docs).collect()
    check_shards(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in EDGES)
    assert sharding.shards(no_docs).count() == 0


def test_small_groups_stay_together(spark):
    rows = sharding.shards(documents(spark, [(i, f"text {i % 150} " * 5, "en", "s") for i in range(600)]), group_share=0.2).collect()
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


# Mixes


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Words to take of each source, in order: shares of all words by repeating weights; what is above twice a source goes to the rest by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        part = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        over = {i for i in open_ if part[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else part[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 50, 3, 0], [0, 0], [5, 900, 1, 40, 7, 7, 7], [1], [3, 3, 300]])
def test_targets_share_the_excess(spark, sizes):
    rows = spark.createDataFrame([(n, float((5, 2, 1)[i % 3])) for i, n in enumerate(sizes)], "source_size long, weight double")
    level = mixing.filled(rows)
    got = [min(level * r.weight, 2.0 * r.source_size) for r in rows.collect()]
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    out = mixing.permuted(np.arange(n), n, 99)
    assert sorted(out) == list(range(n))
    assert n < 64 or (out != mixing.permuted(np.arange(n), n, 100)).any()


def test_word_counts_over_buffers():
    import pyarrow as pa

    texts = [None, "", " a", "a b", "c", "\tx y ", "é è", None, "z"]
    for a in (pa.array(texts), pa.array(["pad me", *texts]).slice(1), pa.array(texts, pa.large_string())):
        assert mixing.word_counts(a).tolist() == [len(split(t)) for t in texts]


def test_registered_mix_reaches_targets(spark, sf):
    from gradeloom.llm import queries

    rows = queries.QUERIES["op10_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r["size"] == len(split(docs[r.doc_id].text)) and r.taken <= 2 * r["size"] and sum(r.shard_words) == r.taken
        taken[docs[r.doc_id].source] += r.taken
        size[docs[r.doc_id].source] += r["size"]
        target[docs[r.doc_id].source] = r.target
    assert all(r.source_size == size[docs[r.doc_id].source] for r in rows)
    order = sorted(size, key=lambda s: (s is None, s))
    assert [target[s] for s in order] == pytest.approx(brute_targets([size[s] for s in order]))
    assert all(abs(taken[s] - t) <= max(1, size[s] // mixing.LEAST, 1) + 1 for s, t in target.items())
    assert {(r.doc_id, r.taken, *r.shard_words) for r in queries.QUERIES["op10_mixing"](spark, sf).collect()} == {(r.doc_id, r.taken, *r.shard_words) for r in rows}


def test_small_sources_meet_their_targets(spark):
    rows = [(0, "w " * 100, "en", "b"), (1, "w " * 10_000, "en", "a"), (2, "w " * 3, "en", "c"), (3, "w " * 1_000, "en", None)]
    got = {r.doc_id: r for r in mixing.taken(documents(spark, rows)).collect()}
    want = dict(zip((1, 0, 2, 3), brute_targets([10_000, 100, 3, 1_000]), strict=True))
    assert {i: got[i].target for i in got} == pytest.approx(want)
    assert all(abs(got[i].taken - want[i]) <= max(1, got[i]["size"] // mixing.LEAST) for i in got)


def test_multinomial_counts_decide_what_shards_take(spark):
    """The slots of each output shard are those that one draw a source gives it, and its words are those of its slots' blocks."""
    rows = [(i, f"w{i} " * (40 + i), "en", "ab"[i % 2]) for i in range(60)]
    docs = documents(spark, rows).select(F.monotonically_increasing_id().alias("__row"), "doc_id", "source", "text")
    pieces, slots = (x.collect() for x in mixing.mix(docs, block=4, shards=5))
    of = {0: "a", 1: "b"}
    for number, source in of.items():
        mine = sorted((r for r in slots if r.__getitem__("__source") == number), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        want = np.random.default_rng([mixing.SEED, mixing.key_of(source, mixing.SEED)]).multinomial(len(mine), [0.2] * 5)
        counts = collections.Counter(r.out_shard for r in mine)
        assert [counts[k] for k in range(5)] == want.tolist() and [r.out_shard for r in mine] == sorted(r.out_shard for r in mine)
        n = 1 + max(r["__block"] for r in mine)
        times = collections.Counter(r["__block"] for r in mine)
        assert set(times.values()) <= {len(mine) // n, -(-len(mine) // n)}
    words = collections.Counter()
    by_block = collections.defaultdict(list)
    for r in pieces:
        by_block[r["__source"], r["__block"]].append((r.doc_id, r.words))
    for r in slots:
        for doc, w in by_block[r["__source"], r["__block"]]:
            words[doc, r.out_shard] += w
    for r in mixing.taken(documents(spark, rows), block=4, shards=5).collect():
        assert r.shard_words == [words[r.doc_id, k] for k in range(5)]


def test_mix_of_edges(spark, edge_docs, no_docs):
    rows = mixing.taken(edge_docs).collect()
    assert len(rows) == len(EDGES) and all(r.taken <= 2 * r["size"] for r in rows)
    assert sum(r["size"] for r in rows) == sum(len(split(t)) for _, t, *_ in EDGES)
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    got = out.collect()
    assert sum(len(split(r.text)) for r in got) == sum(r.taken for r in rows) and all(r.n_chars == len(r.text) for r in got)
    known = {w for _, t, *_ in EDGES for w in split(t)}
    assert all(w in known for r in got for w in split(r.text))
    assert mixing.taken(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_hot_source_by_join_and_by_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, "a b c d e f", "en", "hot" if i % 3 else f"s{i}") for i in range(300)]
    got = mixing.taken(documents(spark, rows)).collect()
    total = sum(r.taken for r in got if r.source_size > 6)
    assert len(got) == 300 and total == pytest.approx(next(r.target for r in got if r.source_size > 6), abs=8)


def test_a_block_deletes_what_was_written_in_it_and_nothing_else(spark):
    import os
    import threading

    from gradeloom.llm import shared

    before = shared.durable(spark.range(2))
    other = []
    with shared.passing(spark) as own:
        kept = shared.durable(spark.range(3))
        assert kept.count() == 3
        with shared.passing(spark) as inner:
            shared.durable(spark.range(5))
        thread = threading.Thread(target=lambda: other.append(shared.durable(spark.range(4))))
        thread.start()
        thread.join()
    assert len(own) == len(inner) == 1 and not any(os.path.exists(p.removeprefix("file:")) for p in own + inner)
    assert before.count() == 2 and other[0].count() == 4
    with pytest.raises(RuntimeError), shared.passing(spark) as own:
        shared.durable(spark.range(1))
        raise RuntimeError
    assert not os.path.exists(own[0].removeprefix("file:"))


def test_hot_copies_are_one_row_of_a_sample(spark):
    from gradeloom.llm import langid

    rows = [(1, "der und mit", "de", "s")] * 400 + [(i, f"the and with {i}", "en", "s") for i in range(2, 30)]
    model = langid.train(documents(spark, rows), F.lit(True), sample=20)
    assert "en" in model.languages


def plain_shards(rows, count, share):
    """Law ``bytes`` by one loop: rows are (doc_id, text, hash of the text); doc_id, size, crc, shard and slot of each."""
    line = sorted(((h, (i is not None, i or 0), t or "") for i, t, h in rows), key=lambda r: r[:2])
    sizes = [len(t.encode()) + 1 for _, _, t in line]
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    total, cuts = sum(sizes), []
    for k in range(1, count):
        cut = total * k / count
        for h in {r[0] for r in line}:
            own = [j for j, r in enumerate(line) if r[0] == h]
            a, z = starts[own[0]], starts[own[-1]] + sizes[own[-1]]
            if a < cut < z and z - a <= share * total / count:
                cut = a if cut - a <= z - cut else z
        cuts.append(cut)
    out, filled = [], collections.Counter()
    for (_, (there, i), t), start, size in zip(line, starts, sizes):
        shard = sum(c <= start + size / 2 for c in cuts)
        out.append((i if there else None, size, zlib.crc32(t.encode()), shard, filled[shard]))
        filled[shard] += 1
    return out


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_shards_equal_one_loop(spark, share):
    rng = random.Random(6)
    rows = [(i, rng.choice(["aä " * rng.randint(0, 40), "copy " * 20, "other copy", None, ""]), "en", "s") for i in range(120)] + [(None, "copy " * 20, "en", "s"), (None, None, "en", "s"), (7, "copy " * 20, "en", "s"), (500, "long " * 3_000, "en", "s")]
    docs = documents(spark, rows).repartition(7)
    hashes = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    got = sorted((tuple(r) for r in sharding.shards(docs, 8, share).collect()), key=str)
    want = sorted(plain_shards(hashes, 8, share), key=str)
    # Rows of one id and text stand in any order among themselves.
    assert got == want
