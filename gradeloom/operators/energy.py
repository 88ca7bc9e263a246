"""Sensor series into energy and cost: intervals, trapezoids, counters that wrap, time-of-use periods and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: US dollars a kWh by season and period, and the credit of the first tier.
RATES = {"summer": {"super_off": 0.38773, "off": 0.47505, "on": 0.69572}, "winter": {"super_off": 0.44880, "off": 0.53956, "on": 0.62127}}
TIER_CREDIT = 0.10892


def intervals(samples: DataFrame, series: list[str], at: str, value: str, order: list[str] = ()) -> DataFrame:
    """Each sample but a series' first with the seconds since the one before, the middle of that time, and joules by the trapezoid.

    If one of the two watts is missing the other counts for the whole interval; if both are, joules are null. Time never runs backwards.
    """
    w = Window.partitionBy(*series).orderBy(at, *order)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = samples.withColumns({"__t": t, "__before": F.lag(t).over(w), "__v": F.lag(value).over(w)}).filter("__before IS NOT NULL")
    seconds = F.greatest(F.lit(0.0), (F.col("__t") - F.col("__before")) / F.lit(1e6))
    middle = F.timestamp_micros(F.floor((F.col("__t") + F.col("__before")) / 2).cast("long"))
    watts = (F.coalesce(F.col("__v"), F.col(value)) + F.coalesce(F.col(value), F.col("__v"))) / 2
    return rows.withColumns({"seconds": seconds, "middle": middle, "joules": watts * seconds}).drop("__t", "__before", "__v")


def counter_delta(before: Column, now: Column, limit: Column | None = None) -> Column:
    """Growth of a counter that may have wrapped at ``limit``; null if it fell and there is no limit."""
    wrapped = F.when(limit > 0, limit - before + now) if limit is not None else F.lit(None).cast("double")
    delta = F.when(now >= before, now - before).otherwise(wrapped)
    return F.when((delta > 0) & ~F.isnan(delta.cast("double")) & (F.abs(delta) < float("inf")), delta)


def season(day: Column) -> Column:
    return F.when(F.month(day).between(6, 10), "summer").otherwise("winter")


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Dates of the eight days priced as weekends: a calendar by rule, one row a day."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    date = lambda m, d: F.make_date("y", F.lit(m), F.lit(d))
    nth = lambda m, day, n: F.date_add(F.next_day(F.date_sub(date(m, 1), 1), day), 7 * (n - 1))
    named = {"New Year's Day": date(1, 1), "Presidents' Day": nth(2, "Mon", 3), "Memorial Day": F.next_day(F.date_sub(F.last_day(date(5, 1)), 7), "Mon"), "Independence Day": date(7, 4), "Labor Day": nth(9, "Mon", 1), "Veterans Day": date(11, 11), "Thanksgiving": nth(11, "Thu", 4), "Christmas Day": date(12, 25)}
    return years.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("day")) for k, v in named.items()))).alias("h")).select("h.day", "h.name")


def period(at: Column, weekend: Column) -> Column:
    """super_off, off or on by the hour; ``weekend`` holds on weekends and holidays."""
    hour = F.hour(at)
    free = F.when(hour < 14, "super_off").when(hour.between(16, 20), "on").otherwise("off")
    work = F.when((hour < 6) | hour.between(10, 13), "super_off").when(hour.between(16, 20), "on").otherwise("off")
    return F.when(weekend, free).otherwise(work)


def rate(season_: Column, period_: Column, credit: bool = False) -> Column:
    out = None
    for s, prices in RATES.items():
        for p, price in prices.items():
            test, value = (season_ == s) & (period_ == p), F.lit(price - (TIER_CREDIT if credit else 0.0))
            out = F.when(test, value) if out is None else out.when(test, value)
    return out


def priced(rows: DataFrame, days: DataFrame, credit: bool = False, flat: float | None = None) -> DataFrame:
    """Intervals with season, period, rate, kWh and cost; ``days``: holidays, a few rows a year. ``credit``: the first tier's; ``flat``: one rate at all times, in the season
    "all" and the period "flat"."""
    day = F.to_date("middle")
    if flat is not None:
        out = rows.withColumns({"season": F.lit("all"), "period": F.lit("flat"), "rate": F.lit(float(flat))})
    else:
        marked = rows.join(F.broadcast(days.select(F.col("day").alias("__day"))), day == F.col("__day"), "left")
        out = marked.withColumns({"season": season(day), "period": period(F.col("middle"), (F.weekday(day) >= 5) | F.col("__day").isNotNull())}).drop("__day")
        out = out.withColumn("rate", rate(F.col("season"), F.col("period"), credit))
    return out.withColumn("kwh", F.col("joules") / F.lit(3.6e6)).withColumn("cost", F.col("kwh") * F.col("rate"))


def breakdown(rows: DataFrame, *keys: str) -> DataFrame:
    """Energy and cost by key, season and period."""
    return rows.groupBy(*keys, "season", "period").agg(F.count("*").alias("intervals"), F.round(F.sum("joules"), 1).alias("joules"), F.round(F.sum("cost"), 6).alias("cost_usd"), F.min_by("rate", "middle").alias("rate"))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Seconds, kWh, cost and average watts (by time) of each series."""
    joules, seconds = F.sum("joules"), F.sum("seconds")
    return rows.groupBy(*keys).agg(F.round(seconds, 3).alias("seconds"), F.round(F.sum("kwh"), 6).alias("kwh"), F.round(F.sum("cost"), 6).alias("cost_usd"), F.round(F.coalesce(F.try_divide(joules, seconds), F.lit(0.0)), 3).alias("average_watts"))


def components(samples: DataFrame, key: str, kind: str, value: str, names: list[str]) -> DataFrame:
    """Average watts of each series, over all and by component."""
    return samples.groupBy(key).agg(F.round(F.avg(value), 4).alias("watts"), *(F.round(F.avg(F.when(F.col(kind) == n, F.col(value))), 4).alias(f"watts_{n}") for n in names))
