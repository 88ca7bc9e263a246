"""Samples, splits, similarity and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as M
from ..operators import splitting as P
from .registry import ORACLES, query, table


@query("stratified_largest_remainder", """
WITH g AS (SELECT lang, source, count(*) AS available FROM documents GROUP BY 1, 2),
r AS (SELECT *, 180 * CAST(available AS DOUBLE) / CAST(sum(available) OVER () AS DOUBLE) AS raw FROM g),
b AS (SELECT *, least(CAST(floor(raw) AS BIGINT), available) AS base FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY base < available DESC, raw - floor(raw) DESC, lang DESC, source DESC) AS n, 180 - sum(base) OVER () AS spare FROM b),
q AS (SELECT lang, source, base + CASE WHEN base < available AND n <= spare THEN 1 ELSE 0 END AS quota FROM o),
d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('151:' || doc_id), doc_id) AS position FROM documents)
SELECT doc_id, d.lang, d.source FROM d JOIN q USING (lang, source) WHERE position <= quota""")
def stratified_largest_remainder(spark, d):
    return P.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 180, 151).select("doc_id", "lang", "source")


_SPLIT = """
WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('123:' || doc_id), doc_id) AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT doc_id, lang, CASE WHEN position <= floor(CAST(0.7 AS DOUBLE) * n) THEN 'train' WHEN position <= floor(CAST(0.7 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n) THEN 'dev' ELSE 'holdout' END AS split FROM p)
"""


@query("split_70_15_15", _SPLIT + "SELECT doc_id, lang, split FROM s")
def split_70_15_15(spark, d):
    return P.split3(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 123).select("doc_id", "lang", "split")


@query("disjoint_check", _SPLIT + "SELECT count(*) AS documents, (SELECT count(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaks FROM s")
def disjoint_check(spark, d):
    parts = split_70_15_15(spark, d)
    return parts.groupBy("doc_id").agg(F.count_distinct("split").alias("parts"), F.count("*").alias("n")).agg(F.sum("n").alias("documents"), F.count_if(F.col("parts") > 1).alias("leaks"))


@query("hash_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, d):
    return P.sampled(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


@query("range_split", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 100 THEN 'dev' WHEN n <= 200 THEN 'holdout' ELSE 'train' END AS split FROM o""")
def range_split(spark, d):
    return P.ranges(table(spark, d, "documents").select("doc_id"), "doc_id", 9, dev=100, holdout=100)


@query("source_quota_mix", """
SELECT doc_id, source FROM documents JOIN (VALUES ('src0', 40), ('src1', 20), ('src2', 10)) q(source, quota) USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('529:' || doc_id), doc_id) <= any_value(quota) OVER (PARTITION BY source)""")
def source_quota_mix(spark, d):
    return P.by_source(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", {"src0": 40, "src1": 20, "src2": 10}, 529).select("doc_id", "source")


@query("balanced_subset", """
WITH p AS (SELECT doc_id, lang = 'en' AS mcq, row_number() OVER (PARTITION BY lang = 'en' ORDER BY md5('151:' || doc_id), doc_id) AS n FROM documents),
c AS (SELECT least(50, count(*) FILTER (WHERE mcq)) AS m, count(*) FILTER (WHERE NOT mcq) AS f, count(*) FILTER (WHERE mcq) AS allm FROM p)
SELECT doc_id, mcq FROM p, c WHERE n <= CASE WHEN mcq THEN least(allm, m + greatest(0, 100 - m - f)) ELSE least(f, 100 - m) END""")
def balanced_subset(spark, d):
    rows = P.numbered(table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("mcq")), ["mcq"], "doc_id", 151)
    n = rows.agg(F.count_if("mcq").alias("m"), F.count_if(~F.col("mcq")).alias("f")).first()
    half = min(50, n.m)
    free = min(n.f, 100 - half)
    return rows.filter(F.col("position") <= F.when(F.col("mcq"), min(n.m, half + max(0, 100 - half - n.f))).otherwise(free)).select("doc_id", "mcq")


@query("part_index", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 250) AS BIGINT) AS part FROM documents")
def part_index(spark, d):
    return P.part_numbers(table(spark, d, "documents").select("doc_id"), "doc_id", 250)


@query("embedding_stats", """
WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT label, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS low, max(x) AS high, avg(abs(x)) AS abs_mean, sum(x * x) AS squares, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM x GROUP BY 1)
SELECT label, n, round(mean, 5) AS mean, round(std, 5) AS std, round(low, 5) AS low, round(high, 5) AS high, round(abs_mean, 5) AS abs_mean, round(zero_share, 5) AS zero_share, round(sqrt(squares), 5) AS l2, round(squares / sum(squares) OVER (), 5) AS share FROM s""")
def embedding_stats(spark, d):
    return M.array_stats(table(spark, d, "embeddings"), "label", "embedding")


@query("embedding_cosine_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_dot_product(q.v, c.v) / (q.n * c.n), 5) AS cosine FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, candidate_id) AS rank, candidate_id, cosine FROM s QUALIFY rank <= 3""")
def embedding_cosine_topk(spark, d):
    # The query set of searches: rows with ids divisible by 100, which grows with the table.
    return M.cosine_top_k(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 3)


@query("systematic_sample", """
SELECT vec_id, round(list_sum(list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x, i: (i - 1) % 8 = 0)[1:5]), 5) AS sampled_sum FROM embeddings""")
def systematic_sample(spark, d):
    picked = P.systematic(F.col("embedding"), F.lit(8), 5)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(picked, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("sampled_sum"))


@query("percentiles", """
SELECT lang, round(quantile_cont(n_chars, 0.01), 4) AS p1, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents GROUP BY lang""")
def percentiles(spark, d):
    found = P.quantiles(table(spark, d, "documents").select("lang", "n_chars"), ["lang"], "n_chars", [0.01, 0.5, 0.99])
    return found.select("lang", *(F.round(F.get("quantiles", F.lit(i)), 4).alias(n) for i, n in enumerate(("p1", "p50", "p99"))))


_GRAMS = """
WITH t AS (SELECT 'q' AS side, item_id AS id, lower(text) AS text FROM benchmark UNION ALL SELECT 'c', conv_id * 1000 + turn, lower(text) FROM conversations),
w AS (SELECT side, id, ' ' || unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) || ' ' AS w FROM t),
g AS (SELECT side, id, unnest(list_concat(
    CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) ELSE [w] END,
    CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4)) ELSE [] END,
    CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda i: substring(w, i, 5)) ELSE [] END)) AS gram FROM w),
c AS (SELECT side, id, gram, count(*) AS tf FROM g GROUP BY ALL),
f AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM c GROUP BY 1),
r AS (SELECT side, id, gram, (1 + ln(tf::DOUBLE)) * idf AS raw FROM c JOIN f USING (gram)),
n AS (SELECT side, id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY ALL),
u AS (SELECT side, id, gram, raw / norm AS w FROM r JOIN n USING (side, id)),
s AS (SELECT q.id AS query_id, c.id AS candidate_id, round(sum(q.w * c.w), 6) AS similarity FROM u q JOIN u c USING (gram) WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank, candidate_id, similarity FROM s QUALIFY rank <= 3)
"""


def _sides(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return queries, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@query("topk_similarity", _GRAMS + "SELECT * FROM k")
def topk_similarity(spark, d):
    return M.most_similar(*_sides(spark, d), 3)


@query("similarity_metrics", _GRAMS + ", b AS (SELECT item_id, coalesce(similarity, 0) AS s FROM benchmark LEFT JOIN (SELECT * FROM k WHERE rank = 1) ON item_id = query_id) SELECT count(*) AS queries, round(avg(s), 5) AS mean_best, round(quantile_cont(s, 0.5), 5) AS median_best, count(*) FILTER (WHERE s >= 0.3) AS at_least_30, count(*) FILTER (WHERE s >= 0.5) AS at_least_50 FROM b")
def similarity_metrics(spark, d):
    queries, candidates = _sides(spark, d)
    return M.best_metrics(queries, M.most_similar(queries, candidates, 1))


#: The same over documents, the candidates that the survey plans.
_DOCUMENT_GRAMS = _GRAMS.replace("SELECT 'c', conv_id * 1000 + turn, lower(text) FROM conversations", "SELECT 'c', doc_id, lower(text) FROM documents")


def _document_sides(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return queries, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("topk_similarity_documents", _DOCUMENT_GRAMS + "SELECT * FROM k")
def topk_similarity_documents(spark, d):
    return M.most_similar(*_document_sides(spark, d), 3)


@query("similarity_metrics_documents", ORACLES["similarity_metrics"].replace(_GRAMS, _DOCUMENT_GRAMS))
def similarity_metrics_documents(spark, d):
    queries, candidates = _document_sides(spark, d)
    return M.best_metrics(queries, M.most_similar(queries, candidates, 1))
