"""What is written and read again: ledgers, tensor files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.cutting import shared_folder
from ..sources import ledgers
from ..sources.tensors import tensors, write_tensors
from .registry import query, table


@query("ledger_appends", """
SELECT o_orderpriority AS priority, count(*) AS orders, count(DISTINCT o_orderstatus) AS appends, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def ledger_appends(spark, d):
    """Orders appended by status, one append made twice, and one killed before it ended; then read whole."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for status in ("F", "O", "P", "F"):
        ledgers.append(orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").withColumn("status", F.lit(status)), path, f"status-{status}")
    orders.withColumn("status", F.lit("killed")).drop("o_orderstatus").write.csv(f"{path}/{ledgers.ROWS}/killed", header=True)
    rows = ledgers.read(spark, path, "o_orderkey long, o_orderpriority string, status string")
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.count_distinct("status").alias("appends"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.sum("o_orderkey").alias("keys"))


@query("tensor_ranges", """
WITH n AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'v' || vec_id AS key, (i // 24)::BIGINT AS part, count(*) AS n, min(x) AS low, max(x) AS high, round(sum(x), 4) AS total FROM n GROUP BY vec_id, part""")
def tensor_ranges(spark, d):
    """Embeddings as tensor files, read again in blocks of 24 numbers, several tasks to a file."""
    path = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    write_tensors(rows.select(F.concat(F.lit("v"), "vec_id").alias("key"), F.lit("F32").alias("kind"), F.array(F.size("embedding").cast("long")).alias("shape"), F.col("embedding").cast("array<double>").alias("numbers")), path)
    x = F.explode("numbers").alias("x")
    return tensors(spark, path, 24).select("key", "part", x).groupBy("key", "part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.sum("x"), 4).alias("total"))
