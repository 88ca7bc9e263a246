"""Energy, counters and calendars over the events table: value is watts, user_id a series."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import energy as E
from ..operators.cutting import shared_folder
from ..streaming import power
from .registry import ORACLES, query, table

_STEPS = """
WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER w AS b, lag(value) OVER w AS bv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_id, greatest(0.0::DOUBLE, (t - b) / 1000000.0::DOUBLE) AS seconds, make_timestamp(CAST(floor((t + b) / 2) AS BIGINT)) AS middle, (coalesce(bv, value) + coalesce(value, bv)) / 2 AS watts FROM t WHERE b IS NOT NULL),
j AS (SELECT *, watts * seconds AS joules FROM i)
"""


def _intervals(spark, d):
    return E.intervals(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "value", ["event_id"])


@query("energy_trapezoid", _STEPS + "SELECT user_id, count(*) AS intervals, round(sum(seconds), 3) AS seconds, round(sum(joules), 1) AS joules FROM j GROUP BY user_id")
def energy_trapezoid(spark, d):
    return _intervals(spark, d).groupBy("user_id").agg(F.count("*").alias("intervals"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.sum("joules"), 1).alias("joules"))


def _priced(spark, d):
    """Intervals at the prices of the days they lie in; the calendar has every year from the first event's to the last one's."""
    first, last = table(spark, d, "events").agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    return E.priced(_intervals(spark, d), E.holidays(spark, first, last) if first else E.holidays(spark, 1, 0))


_DAYS = """
y AS (SELECT unnest(range({0}, {1})) AS y),
h AS (
  SELECT make_date(y, 1, 1) AS day, 'New Year''s Day' AS name FROM y UNION ALL SELECT make_date(y, 7, 4), 'Independence Day' FROM y UNION ALL SELECT make_date(y, 11, 11), 'Veterans Day' FROM y UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day' FROM y
  UNION ALL SELECT CAST(d AS DATE), n FROM y, (VALUES (2, 1, 3, 'Presidents'' Day'), (9, 1, 1, 'Labor Day'), (11, 4, 4, 'Thanksgiving')) r(m, dow, k, n), LATERAL (SELECT unnest(generate_series(make_date(y, m, 1), last_day(make_date(y, m, 1)), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = dow AND (day(d) - 1) // 7 = k - 1
  UNION ALL SELECT CAST(max(d) AS DATE), 'Memorial Day' FROM y, LATERAL (SELECT unnest(generate_series(make_date(y, 5, 25), make_date(y, 5, 31), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 1 GROUP BY y)
"""
_PRICES = """
, """ + _DAYS.format(2024, 2025).strip() + """,
p AS (SELECT j.*, CASE WHEN month(middle) BETWEEN 6 AND 10 THEN 'summer' ELSE 'winter' END AS season, isodow(middle) >= 6 OR CAST(middle AS DATE) IN (SELECT day FROM h) AS weekend, hour(middle) AS hr FROM j),
q AS (SELECT *, CASE WHEN hr BETWEEN 16 AND 20 THEN 'on' WHEN weekend AND hr < 14 THEN 'super_off' WHEN NOT weekend AND (hr < 6 OR hr BETWEEN 10 AND 13) THEN 'super_off' ELSE 'off' END AS period FROM p),
r AS (SELECT *, CAST(CASE season || period WHEN 'summersuper_off' THEN 0.38773 WHEN 'summeroff' THEN 0.47505 WHEN 'summeron' THEN 0.69572 WHEN 'wintersuper_off' THEN 0.44880 WHEN 'winteroff' THEN 0.53956 ELSE 0.62127 END AS DOUBLE) AS rate FROM q)
"""


@query("energy_tou_cost", _STEPS.rstrip() + _PRICES + "SELECT user_id, season, period, count(*) AS intervals, round(sum(joules), 1) AS joules, round(sum(joules / 3.6e6::DOUBLE * rate), 6) AS cost_usd, max(rate) AS rate FROM r GROUP BY ALL")
def energy_tou_cost(spark, d):
    return E.breakdown(_priced(spark, d), "user_id")


@query("energy_summary", _STEPS.rstrip() + _PRICES + "SELECT user_id, round(sum(seconds), 3) AS seconds, round(sum(joules / 3.6e6::DOUBLE), 6) AS kwh, round(sum(joules / 3.6e6::DOUBLE * rate), 6) AS cost_usd, round(coalesce(sum(joules) / nullif(sum(seconds), 0), 0), 3) AS average_watts FROM r GROUP BY ALL")
def energy_summary(spark, d):
    return E.summary(_priced(spark, d), "user_id")


@query("counter_wrap", """
WITH c AS (SELECT user_id, event_id, CAST(event_id * 37 % 1000 AS DOUBLE) AS v, CAST(lag(event_id * 37 % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS b FROM events),
d AS (SELECT user_id, CASE WHEN v >= b THEN v - b ELSE 1000 - b + v END AS x FROM c)
SELECT user_id, count(*) FILTER (WHERE x > 0) AS steps, round(sum(x) FILTER (WHERE x > 0), 1) AS total FROM d GROUP BY user_id""")
def counter_wrap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = table(spark, d, "events").withColumn("v", (F.col("event_id") * 37 % 1000).cast("double"))
    deltas = c.select("user_id", E.counter_delta(F.lag("v").over(w), F.col("v"), F.lit(1000.0)).alias("x"))
    return deltas.groupBy("user_id").agg(F.count("x").alias("steps"), F.round(F.sum("x"), 1).alias("total"))


@query("holiday_calendar", "WITH " + _DAYS.format(2024, 2028) + "SELECT day, name FROM h")
def holiday_calendar(spark, d):
    return E.holidays(spark, 2024, 2027)


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    from ..streaming.events import tumbling

    return tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("energy_stream", ORACLES["energy_trapezoid"])
def energy_stream(spark, d):
    """The events as a stream: in four batches, each up to two days out of order, then a sample that settles all; the same as over the table."""
    folder = f"{shared_folder(spark)}/energy-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    if first is None:
        return energy_trapezoid(spark, d)
    moved = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    batch = F.least(F.lit(3), F.floor((moved - first) * 4 / (last - first + 1)))
    rows = events.withColumn("batch", batch)
    for i in range(4):
        rows.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    settles = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(last + 30 * 86_400)).alias("ts"), F.lit(0.0).alias("value"))
    settles.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(settles.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query_ = power.started(power.intervals(stream, "user_id", "ts", "value", "event_id", "3 days"), f"{folder}/out", f"{folder}/state")
    query_.awaitTermination()
    done = spark.read.schema(power.INTERVAL).parquet(f"{folder}/out").filter("series <> '-1'")
    return done.groupBy(F.col("series").cast("long").alias("user_id")).agg(F.count("*").alias("intervals"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.sum("joules"), 1).alias("joules"))
