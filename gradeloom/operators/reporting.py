"""Reports as text columns: one small row a report, made of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .splitting import quantiles


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row with a Markdown table of an aggregate's rows, in order; for reports, whose rows are few."""
    names = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), F.lit(" |"))
    head = "| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("report"))


def html_index(rows: DataFrame, label: str, count: str, ranks: Column) -> DataFrame:
    """One row with an HTML list of labels and counts, in the order of ``ranks`` and then of the label."""
    item = F.concat(F.lit("<li>"), html_escape(F.col(label)), F.lit(": "), F.col(count).cast("string"), F.lit("</li>"))
    items = F.transform(F.sort_array(F.collect_list(F.struct(ranks.alias("r"), F.col(label).alias("l"), item.alias("i")))), lambda x: x["i"])
    return rows.agg(F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")).alias("html"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins between the 1st and the 99th percentile, values beyond clipped to them."""
    low, high = quantiles(rows, [], value, [0.01, 0.99]).first()[0]
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(low)), F.lit(high))
    step = (high - low) / bins or 1.0
    at = F.least(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("long")
    return rows.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
