"""The pipeline, stage by stage, each against what its rule says of every row."""

import collections
import hashlib
import os

import corpus_pipeline
import pytest

from gradeloom.llm import bpe, jaccard, langid, mixing, toxicity
from gradeloom.llm.shared import crc_fold

from .conftest import EDGES


def test_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf)
        result.write.parquet(str(tmp_path / name))
        out[name] = (docs.collect(), docs)
        docs = spark.read.schema(result.schema).parquet(str(tmp_path / name))
    final = docs.collect()
    # Language: every row by the model, one at a time.
    before, frame = out["language"]
    folds, held = langid.HELD_OUT
    model = langid.train(frame.select("doc_id", "text", "lang"), crc_fold("doc_id", folds) != held)
    want = {r.doc_id for r in before if (p := model.predict(r.text))[0] != langid.UNKNOWN and p[1] >= 0.3}
    assert {r.doc_id for r in out["toxicity"][0]} == want
    # Toxicity.
    before, frame = out["toxicity"]
    folds, held = toxicity.HELD_OUT
    index = toxicity.train(frame.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), crc_fold("doc_id", folds) != held)
    assert {r.doc_id for r in out["near_duplicates"][0]} == {r.doc_id for r in before if index.score(r.text or "")[0] < 0.5}
    # Near duplicates: the smallest id of each connected class of similar sets.
    before, _ = out["near_duplicates"]
    sets = {r.doc_id: set(jaccard.grams(r.text or "").tolist()) for r in before}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id for r in out["mixing"][0]} == {i for i in sets if find(i) == i}
    # Mixing: the words of each document are those that the query's rule takes.
    before, frame = out["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.taken(frame).collect()}
    mixed = out["tokens"][0]
    got = collections.Counter()
    for r in mixed:
        got[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(got)
    # Tokens.
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    want = collections.Counter((r.doc_id, hashlib.sha256(bytes(c.encode(r.text))).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    assert collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in final) == want
    # The whole.
    run = corpus_pipeline.run(spark, sf)
    assert collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in run.collect()) == want
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(len(os.listdir(f"{folder}/{f}")) == 1 for f in os.listdir(folder) if f.startswith("pipeline-"))


@pytest.mark.parametrize("which", range(len(corpus_pipeline.STAGES)))
def test_edges(spark, sf, edge_docs, no_docs, which):
    stage = corpus_pipeline.STAGES[which][1]
    out = stage(spark, edge_docs, sf)
    rows = out.collect()
    assert 0 < len(rows) <= 8 * 2 * len(EDGES)
    assert which == 4 or out.columns == edge_docs.columns
    ids = collections.Counter(str(r.doc_id) for r in rows)
    if which == 0:  # no letter, no language
        assert not {"3", "4", "5", "9"} & ids.keys() and ids["1"] == 1 and ids["2"] == 2
    if which == 2:
        assert ids["1"] == 1 and "2" not in ids and all(ids[i] == 1 for i in "3457")
    if which == 3:
        assert not {"3", "4", "5"} & ids.keys()
    if which == 4:
        assert len(rows) == len(EDGES) and all(r.n_tokens == 0 for r in rows if r.doc_id in (3, 4))
    assert stage(spark, no_docs, sf).count() == 0
