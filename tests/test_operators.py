"""Operators on small made rows: cases that the shared tables lack."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.columns import own_names
from evigraph.operators import mining, relational, stats
from evigraph.plans import literature
from evigraph.sources import tables


def test_names_clash_with_nothing():
    assert own_names(["a", "B"], "rank") == ["_rank"]
    assert own_names(["_rank", "__X", "___"], "rank", "key") == ["____rank", "____key"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_quantiles_are_exact(spark, n):
    r = random.Random(n)
    rows = [(round(r.gauss(0, 5), 1), float(r.randrange(3)), None) for _ in range(n)] + [(None, None, None)] * 3
    points = [0.0, 0.25, 0.5, 0.8, 1.0]
    one = stats.quantiles(spark.createDataFrame(rows, "a double, b double, c double").repartition(3), {c: F.col(c) for c in "abc"}, points).first()
    for i, c in enumerate("ab"):
        values = [x[i] for x in rows if x[i] is not None]
        assert (one[c] is None) == (n == 0)
        if n:
            assert one[c] == pytest.approx(np.quantile(values, points).tolist())
    assert one["c"] is None


def test_one_row_is_one_row(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "_row int, x int")
    got = stats.with_row(df, spark.createDataFrame([(9, None)], "y int, z int"))
    assert got.columns == ["_row", "x", "y", "z"] and {tuple(r) for r in got.collect()} == {(1, 2, 9, None), (3, 4, 9, None)}
    assert {tuple(r) for r in stats.with_row(df, df.limit(0).select(F.col("x").alias("y"))).collect()} == {(1, 2, None), (3, 4, None)}
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        stats.with_row(df, df.select(F.col("x").alias("y"))).collect()


def test_subsets_that_are_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "_key int, v string")
    keys = spark.createDataFrame([(2,), (2,), (None,)], "_key int")
    assert {r.v for r in relational.restrict(df, keys, "_key").collect()} == {"b"}
    assert {r.v for r in relational.restrict(df, keys.limit(0), "_key").collect()} == {"a", "b", "c"}
    assert relational.restrict(df, None, "_key") is df
    assert {r.v for r in relational.keep_matching_else_all(df, F.col("_key") > 1).collect()} == {"b"}
    assert {r.v for r in relational.keep_matching_else_all(df, F.col("_key") > 5).collect()} == {"a", "b", "c"}
    assert not relational.is_small(spark.range(relational.BROADCAST_ROWS + 1)) and relational.is_small(df)
    assert not relational.is_small(spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("x")))


@pytest.mark.parametrize("width", [0, 1, 3])
def test_neighbours_within_a_document(spark, width):
    r = random.Random(width)
    rows = [(i, " ".join(r.choice(["Aa near it.", "Bb direct it.", "Cc nothing.", "Dd near direct!"]) for _ in range(r.randrange(0, 25)))) for i in range(20)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = mining.banded_sentences(docs, "id", F.col("text"), "near", "direct", width)
    flags = mining.flag_cues(mining.split_sentences(docs, "id", F.col("text")), {"n": "near", "d": "direct"})
    want = mining.any_in_band(mining.band(flags, "id", "n", width), "id", "d", width, "direct_near").select("id", "idx", "sentence", "near", "direct_near")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_links_of_many_documents(spark):
    rows = [("g", "d", i % 40, "positive" if i % 3 else "negative") for i in range(200)] + [("g", "e", 5, "neutral")]
    got = {r.d: r for r in mining.links(spark.createDataFrame(rows, "g string, d string, doc int, polarity string"), "doc", "g", "d").collect()}
    assert (got["d"].evidence_count, got["d"].docs, got["d"].n_positive, got["d"].n_negative, got["d"].direction, got["d"].relationship) == (40, ["0", "1", "10"], 133, 67, "positive", "risk_factor")
    assert (got["e"].evidence_count, got["e"].docs, got["e"].relationship) == (1, ["5"], "associated")


def test_hits_take_the_first_form(spark):
    rows = spark.createDataFrame([(1, ["A-B", "ab", "x", "C-D", "C-D"])], "id int, t array<string>")
    lexicon = spark.createDataFrame([("A-B", "hyphen"), ("AB", "plain"), ("CD", "joined")], "form string, symbol string")
    got = mining.dictionary_hits(rows, F.col("t"), lexicon, ["id"]).collect()
    assert sorted((r.token, r.symbol) for r in got) == [("A-B", "hyphen"), ("C-D", "joined"), ("ab", "plain")]


def test_lists_of_studies_are_capped(spark):
    rows = [("1", "t", "given 5 mg for 2 weeks", [f"h{i}" for i in range(30)], ["Review"], [f"k{i}" for i in range(30)], ["Human"])]
    papers = spark.createDataFrame(rows, "pmid string, title string, abstract string, mesh_terms array<string>, publication_types array<string>, keywords array<string>, species_tags array<string>")
    s = literature.nested_context(papers).first().study
    assert s.mesh_terms == [f"h{i}" for i in range(15)] and s.keywords == [f"k{i}" for i in range(12)] and s.doses == ["5 mg"] and s.times == ["2 weeks"]


def test_spread(spark, tmp_path):
    """A table in few parts is dealt out over all cores, one in more parts stays as it is."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    assert tables.spread(few).rdd.getNumPartitions() == cores
    assert sorted(r.id for r in tables.spread(few).collect()) == list(range(100))
    many = spark.range(100, numPartitions=cores + 3)
    assert tables.spread(many) is many
