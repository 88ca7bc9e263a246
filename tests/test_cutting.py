"""Tables that a block writes for itself."""

import os
import threading

from pyspark.sql import functions as F

from gradeloom.operators import cutting


def test_a_block_deletes_its_own_tables_only(spark):
    before, other = cutting.cut(spark.range(2)), []
    with cutting.passing(spark) as own:
        assert cutting.cut(spark.range(3)).count() == 3
        thread = threading.Thread(target=lambda: other.append(cutting.cut(spark.range(4))))
        thread.start()
        thread.join()
    assert len(own) == 1 and not os.path.exists(own[0].removeprefix("file:"))
    assert before.count() == 2 and other[0].count() == 4


def test_few_row_groups_are_judged_by_many_tasks(spark, tmp_path):
    """A file of one row group was read, and its rows judged, by one task."""
    from gradeloom.plans import catalogue

    one = spark.range(2_000).selectExpr("id AS p_partkey", "'name' AS p_name").coalesce(1)
    one.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("option_by_value", "letters_by_value", "free_score", "judge_equal", "typed_judge"):
        rows = catalogue.QUERIES[name](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        assert rows.count() == 2_000 and rows.select("task").distinct().count() >= 16, name


def test_few_row_groups_of_orders_and_items(spark, tmp_path):
    from gradeloom.plans import catalogue

    spark.range(2_000).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2_000).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("self_check", "self_consistency", "expression_identity", "typed_split"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= 16, name
