"""Robust statistics, profiles and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.columns import own_names


def quantiles(df: DataFrame, measures: Mapping[str, Column], points: Sequence[float]) -> DataFrame:
    """One row: for each measure an array of its exact quantiles, interpolated; null without values.

    Values are counted, dealt out by range and summed up within each range, so that every rank is
    found where it lies: no task holds more than its own range, whatever the number of values.
    """
    items = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in measures.items()])
    counted = df.select(F.inline(items)).filter("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    # stored, since a second run might cut the ranges elsewhere
    placed = checkpointed(counted.repartitionByRange("name", "value").withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("name", "range").agg(F.sum("n").alias("range_n"))
    before = F.coalesce(F.sum("range_n").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each measure and partition
    sums = sums.select("name", "range", before.alias("before"), F.sum("range_n").over(Window.partitionBy("name")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.withColumn("upto", upto).join(sums, ["name", "range"])
    last = F.col("before") + F.col("upto") - 1
    found = []
    for p in points:
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = (F.max(F.when((r <= last) & (r > last - F.col("n")), F.col("value"))) for r in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        found.append((1 - share) * low + share * high)
    each = rows.groupBy("name").agg(F.array(*found).alias("q"))
    return each.agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in measures])


def robust_stats(df: DataFrame, measures: Mapping[str, Column], exact: bool = True) -> DataFrame:
    """One row: <name>_median and <name>_scale for each measure; scale is the interquartile range over 1.35, at least 0.001.

    exact=False takes approximate quantiles, in one pass without a shuffle of values.
    """
    points = [0.25, 0.5, 0.75]
    got = quantiles(df, measures, points) if exact else df.agg(*[F.percentile_approx(c, F.array(*map(F.lit, points)), 10_000).alias(n) for n, c in measures.items()])
    out = []
    for n in measures:
        q = F.col(n)
        out += [q[1].alias(f"{n}_median"), F.greatest((q[2] - q[0]) / 1.35, F.lit(1e-3)).alias(f"{n}_scale")]
    return got.select(*out)


def data_thresholds(literature: DataFrame, refs: str, inference: DataFrame, score: str) -> DataFrame:
    """One row: min_literature = max(1, half-even rounded upper quartile), min_inference = max(2.5, 80 % quantile)."""
    if literature is inference:
        both = quantiles(literature, {"refs": F.col(refs), "score": F.col(score)}, [0.75, 0.8])
        return both.select(F.greatest(F.lit(1.0), F.bround(F.col("refs")[0], 0)).alias("min_literature"), F.greatest(F.lit(2.5), F.col("score")[1]).alias("min_inference"))
    a = quantiles(literature, {"refs": F.col(refs)}, [0.75]).select(F.greatest(F.lit(1.0), F.bround(F.col("refs")[0], 0)).alias("min_literature"))
    b = quantiles(inference, {"score": F.col(score)}, [0.8]).select(F.greatest(F.lit(2.5), F.col("score")[0]).alias("min_inference"))
    return with_row(a, b)


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table to every row; Spark refuses a table of more rows."""
    (row,) = own_names(df.columns, "row")
    single = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias(row)).scalar()
    return df.select("*", single.alias(row)).select(*[F.col(f"`{c}`") for c in df.columns], f"{row}.*")


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct, non_numeric): counts of every column; distinct values are counted exactly, from one table of values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        text = x.cast("string")
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), F.count_if(x.isNotNull() & text.try_cast("double").isNull()).alias(f"t{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"t{i}").alias("non_numeric")) for i, c in enumerate(df.columns)]
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])))
    distinct = values.filter("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    rows = one.select(F.inline(F.array(*items))).join(distinct, "column", "left")
    return rows.select("column", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "non_numeric")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column, ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(n)


def column_samples(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n least distinct values of a column."""
    return df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(n)
