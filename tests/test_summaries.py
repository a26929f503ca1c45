"""Merged summaries against the whole table."""

import math

from pyspark.sql import functions as F

from evigraph.operators import summaries as M


def rows(spark, n=20_000):
    d = spark.range(n).select((F.col("id") % 5).alias("day"), "id", ((F.xxhash64("id") % 1000) / 10).alias("x"), F.concat(F.lit("k"), F.least(F.col("id") % 50, F.lit(7))).alias("kind"))
    return d.withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x"))).withColumn("kind", F.when(F.col("id") % 13 != 0, F.col("kind")))


def test_parts_are_stored_replaced_and_merged(spark, tmp_path):
    d, path = rows(spark), str(tmp_path / "parts")
    wrong = d.filter("day = 3").withColumn("x", F.lit(1e9))
    args = {"numbers": {"x": F.col("x")}, "values": {"kind": F.col("kind")}}
    M.store_parts(M.summarize(d.filter("day < 3").unionByName(wrong), F.col("day"), **args), path)
    M.store_parts(M.summarize(d.filter("day >= 3"), F.col("day"), **args), path)
    got = {r["name"]: r for r in M.merge(M.load_parts(spark, path)).select("*", M.quantiles([0.1, 0.5, 0.9]).alias("q"), M.distinct().alias("d"), M.frequent(3).alias("f")).collect()}
    x = sorted(r.x for r in d.collect() if r.x is not None)
    assert (got["x"]["rows"], got["x"]["nulls"], got["x"]["least"], got["x"]["greatest"]) == (20_000, 20_000 - len(x), x[0], x[-1])
    assert math.isclose(got["x"]["total"], sum(x), rel_tol=1e-9, abs_tol=1e-6)
    for p, v in zip((0.1, 0.5, 0.9), got["x"]["q"]):
        below, upto = sum(a < v for a in x) / len(x), sum(a <= v for a in x) / len(x)
        assert below - 2 * M.RANK_ERROR <= p <= upto + 2 * M.RANK_ERROR
    assert abs(got["x"]["d"] - len(set(x))) <= 2 * M.DISTINCT_ERROR * len(set(x))
    want = d.filter("kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(1).collect()
    assert [(r["item"], r["count"]) for r in got["kind"]["f"]][:1] == [(r["kind"], r["count"]) for r in want]
    assert got["kind"]["d"] == 8 and got["kind"]["q"] is None and got["kind"]["least"] is None


def test_parts_by_name_and_days_alone(spark, tmp_path):
    d, path = rows(spark, 2000), str(tmp_path / "parts")
    M.store_parts(M.summarize(d, F.col("day"), {"x": F.col("x")}), path)
    some = M.load_parts(spark, path).filter(F.col("part").isin("1", "2"))
    assert "PartitionFilters: [part" in some._jdf.queryExecution().executedPlan().toString()
    assert M.merge(some).first()["rows"] == 800
    assert {r["part"]: r["rows"] for r in M.merge(M.load_parts(spark, path), "part").collect()} == {str(k): 400 for k in range(5)}


def test_without_values_or_rows(spark, tmp_path):
    empty = spark.createDataFrame([(None, None, None), ("a", None, None), ("a", float("nan"), "x")], "day string, x double, kind string")
    path = str(tmp_path / "parts")
    M.store_parts(M.summarize(empty, F.col("day"), {"x": F.col("x")}, {"kind": F.col("kind")}), path)
    got = {r["name"]: r for r in M.merge(M.load_parts(spark, path)).select("name", "rows", "nulls", M.quantiles([0.5]).alias("q"), M.distinct().alias("d"), M.frequent(2).alias("f")).collect()}
    assert (got["x"]["rows"], got["x"]["nulls"], got["x"]["q"], got["x"]["d"]) == (3, 3, None, 0)
    assert [(r["item"], r["count"]) for r in got["kind"]["f"]] == [("x", 1)]
    assert M.summarize(empty.limit(0), F.col("day"), {"x": F.col("x")}).count() == 0
