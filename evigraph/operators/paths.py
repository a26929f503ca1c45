"""Multi-hop paths over ranked edge tables, and graphs and reports made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators import stats


def chain(hops: Sequence[tuple[DataFrame, str, str, int]]) -> DataFrame:
    """Joins edge tables end to end: each hop is (edges, source column, target column, k).

    A hop's rows are cut to those of rank (column <target>_rank) at most k before the join, so that a
    node never fans out further; the target of one hop must be the source of the next. All columns stay.
    """
    edges, _, _, k = hops[0]
    out = edges.filter(F.col(f"{hops[0][2]}_rank") <= k)
    for edges, source, target, k in hops[1:]:
        out = out.join(edges.filter(F.col(f"{target}_rank") <= k), source)
    return out


def network(paths: DataFrame, nodes: Sequence[tuple[str, str]], quality: str, top: int = 50, order: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the best paths; a repeated node or edge has its least quality.

    nodes: (column, kind) along a path. Nodes are (node, kind, quality), edges (src, dst, quality).
    """
    best = paths.orderBy(F.desc(quality), *order).limit(top)
    points = F.array(*[F.struct(F.col(c).alias("node"), F.lit(kind).alias("kind")) for c, kind in nodes])
    links = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for (a, _), (b, _) in zip(nodes, nodes[1:])])
    n = best.select(F.inline(points), quality).groupBy("node", "kind").agg(F.min(quality).alias("quality"))
    e = best.select(F.inline(links), quality).groupBy("src", "dst").agg(F.min(quality).alias("quality"))
    return n, e


def weighted_graph(first: DataFrame, second: DataFrame, a: str, b: str, c: str, evidence: str, weight: int = 3) -> DataFrame:
    """(src, dst, weight): a to b with a fixed weight, b to c with the evidence, at least 1."""
    one = first.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(weight).cast("bigint").alias("weight")).distinct()
    two = second.groupBy(F.col(b).alias("src"), F.col(c).alias("dst")).agg(F.greatest(F.max(evidence), F.lit(1)).cast("bigint").alias("weight"))
    return one.unionByName(two)


def summary(paths: DataFrame, quality: str, distinct: Sequence[str], high: float = 0.75, direct: str | None = None, averaged: Sequence[str] = ()) -> DataFrame:
    """One row: totals, distinct counts, mean, median and 90 % quantile of quality, tier counts; 0 where there are no paths."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("total"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct]]
    aggs.append(zero(F.avg(quality)).alias("mean_quality"))
    after = len(aggs)
    aggs += [F.count_if(F.col(quality) >= high).alias("n_high"), F.count_if(F.col(quality) < high).alias("n_rest")]
    if direct:
        aggs.append(F.count_if(F.col(direct)).alias("n_direct"))
    for c in averaged:
        aggs += [zero(F.avg(c)).alias(f"mean_{c}"), F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(f"max_{c}")]
    one = paths.agg(*aggs)
    q = stats.quantiles(paths, {"q": F.col(quality)}, [0.5, 0.9]).select(zero(F.col("q")[0]).alias("median_quality"), zero(F.col("q")[1]).alias("p90_quality"))
    return stats.with_row(one, q).select(*one.columns[:after], *q.columns, *one.columns[after:])


def contributors(paths: DataFrame, key: str, quality: str, n: int = 5) -> DataFrame:
    """The n keys with most paths, then the best mean quality: (key, paths, mean_quality)."""
    g = paths.groupBy(key).agg(F.count(F.lit(1)).alias("paths"), F.avg(quality).alias("mean_quality"))
    return g.orderBy(F.desc("paths"), F.desc("mean_quality"), key).limit(n)
