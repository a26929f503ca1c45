"""Summaries that merge: each part of a table, a day say, is summarised once and stored; any parts together are read from their summaries alone.

Counts, sums and extremes are exact. Quantiles, distinct values and frequent values are sketches of
bounded size, whatever the size of the part, with errors that hold after any number of merges:
RANK_ERROR and DISTINCT_ERROR (about 99 and 95 % sure). Frequent values are exact up to three
quarters of ITEMS different ones, and beyond that off by at most 3.5 / ITEMS of all values.

A new or corrected part touches no other: its rows take the place of the stored ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a quantile sketch, binary logarithm of the registers for distinct values, different values held as frequent ones.
QUANTILE_SIZE, REGISTERS, ITEMS = 800, 14, 4096
#: Share of all values by which a quantile's rank may be off, and of distinct values their number.
RANK_ERROR, DISTINCT_ERROR = 2.296 / QUANTILE_SIZE**0.9723, 2 * 1.04 / 2 ** (REGISTERS / 2)


def summarize(df: DataFrame, part: Column, numbers: Mapping[str, Column] | None = None, values: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, name, rows, nulls, total, least, greatest, quantiles, items, frequent): a row for each part and measure.

    Measures of `numbers` have total, least, greatest and quantiles; those of `values`, taken as text,
    have frequent; both have items (distinct values). Null and not-a-number count among nulls alone.
    Combined before the only shuffle, which moves sketches. Null part: a part of its own, "". Empty table: no rows.
    """
    measures = [(n, c.cast("double"), True) for n, c in (numbers or {}).items()] + [(n, c.cast("string"), False) for n, c in (values or {}).items()]
    part = F.coalesce(part.cast("string"), F.lit("")).alias("part")
    columns = [F.when(~F.isnan(c), c).alias(f"m{i}") if number else c.alias(f"m{i}") for i, (_, c, number) in enumerate(measures)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (_, _, number) in enumerate(measures):
        m = F.col(f"m{i}")
        own = (
            [F.sum(m).alias("total"), F.min(m).alias("least"), F.max(m).alias("greatest"), F.kll_sketch_agg_double(m, F.lit(QUANTILE_SIZE)).alias("quantiles")]
            if number else [F.lit(None).cast(t).alias(n) for n, t in (("total", "double"), ("least", "double"), ("greatest", "double"), ("quantiles", "binary"))]
        )
        frequent = F.call_function("approx_top_k_accumulate", m.cast("string") if not number else F.lit(None).cast("string"), F.lit(ITEMS))
        # 0.0 and -0.0 are one value
        item = F.when(m == 0, F.lit(0.0)).otherwise(m).cast("string") if number else m
        aggs += [F.count(m).alias(f"n{i}"), F.struct(*own, F.hll_sketch_agg(item, REGISTERS).alias("items"), frequent.alias("frequent")).alias(f"s{i}")]
    one = df.select(part, *columns).groupBy("part").agg(*aggs)
    rows = [F.struct(F.lit(n).alias("name"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"s{i}").alias("s")) for i, (n, _, _) in enumerate(measures)]
    return one.select("part", F.inline(F.array(*rows))).select("part", "name", "rows", "nulls", "s.*")


def store_parts(summary: DataFrame, path: str) -> None:
    """Stores summaries, a folder a part; parts that are stored already are replaced, all others stay as they are."""
    summary.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    """All stored summaries; a filter on part reads the folders of those parts alone."""
    schema = spark.read.parquet(path).schema
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "part"]
    return spark.read.schema(", ".join([*kept, "part string"])).parquet(path)


def merge(parts: DataFrame, *by: str) -> DataFrame:
    """(*by, name, rows, nulls, total, least, greatest, quantiles, items, frequent) of all these parts together, or those alike in `by`."""
    return parts.groupBy(*by, "name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "total")], F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("items").alias("items"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(ITEMS)).alias("frequent"),
    )


def quantiles(points: Sequence[float]) -> Column:
    """Quantiles of a summary's row, values that occur; null without values."""
    has = (F.col("rows") > F.col("nulls")) & F.col("least").isNotNull()
    return F.when(has, F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in points]))


def distinct() -> Column:
    """Number of distinct values of a summary's row."""
    return F.hll_sketch_estimate("items")


def frequent(k: int) -> Column:
    """The k most frequent values of a summary's row, as (item, count), the most frequent first, nulls left out."""
    found = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k + 1))
    return F.slice(F.filter(found, lambda x: x["item"].isNotNull()), 1, k)
