"""The phrase trie, the store, samples of n rows, and counts that a write carries along."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import phrases, relational
from evigraph.sources import store
from evigraph.sources import tables as IO


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# phrases


@pytest.mark.parametrize("small", [True, False])
def test_trie_and_join_find_the_same(spark, monkeypatch, small):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["b-cell", "o'neil", "é", "1,3"]
    texts = [" ".join(r.choice(words) + r.choice(["", ".", ","]) for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "", "...", "W1  W2\nw3", "w1 w1 w1 w1 w1"]
    known = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(400)] + ["w1 w1", "w1 w1 w1", None, "", "w1  w2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = spark.createDataFrame([(p, i % 3) for i, p in enumerate(known)] + [("w1", 9), ("w1", 8)], "phrase string, kind int")
    monkeypatch.setattr(phrases, "is_small", lambda df: small)
    got = phrases.phrase_hits(rows, ["id"], F.col("text"), lexicon, longest=4)
    spans = rows.select("id", F.explode(T.word_phrases(F.col("text"), 4)).alias("phrase"))
    want = spans.join(lexicon, "phrase").select("id", "phrase", "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == want.columns and got.count() > 100


def test_hits_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "a b c")], "id int, text string").repartition(2)
    lexicon = spark.createDataFrame([("a b",), ("c",)], "phrase string")
    plan = plan_of(phrases.phrase_hits(rows, ["id"], F.col("text"), lexicon))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_words_are_found_in_order():
    root = phrases.trie(["a", "a b", "a b c d", "b"])
    assert list(phrases.hits(root, ["x", "a", "b", "c", "a"])) == ["a", "a b", "b"]
    assert list(phrases.hits(root, [])) == []


# the store


@pytest.fixture()
def records(spark, tmp_path):
    name = f"records_{uuid.uuid4().hex}"
    store.create_store(spark, name, f"{tmp_path}/first", buckets=8)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write(spark, name, rows):
    df = spark.createDataFrame(rows, "k string, at string, p string")
    store.upsert(df, name, F.col("k"), F.col("p"), F.col("at"))


def last(spark, name):
    return {r.key: (str(r.saved_at)[:10], r.a, r.b) for r in store.latest(spark, name).select("key", "saved_at", store.field("$.a", "bigint").alias("a"), store.field("$.b[1]", "string").alias("b")).collect()}


def test_last_write_wins(spark, records, tmp_path):
    assert last(spark, records) == {}
    write(spark, records, [("x", "2024-05-01", '{"a": 1}'), ("x", "2024-05-02", '{"a": 2}'), ("y", "2024-05-01", '{"a": "no number", "b": ["p", "q"]}'), (None, "2024-05-01", "{}"), ("z", "2024-05-01", "no json")])
    assert last(spark, records) == {"x": ("2024-05-02", 2, None), "y": ("2024-05-01", None, "q")}
    # an earlier time in a later write still wins
    write(spark, records, [("x", "2023-01-01", '{"a": 3}'), ("w", "2024-06-01", "[1]")])
    want = {"x": ("2023-01-01", 3, None), "y": ("2024-05-01", None, "q"), "w": ("2024-06-01", None, None)}
    assert last(spark, records) == want
    store.compact(spark, records, f"{tmp_path}/second")
    assert last(spark, records) == want and spark.table(records).count() == 3
    write(spark, records, [("y", "2024-07-01", '{"a": 9}')])
    assert last(spark, records)["y"] == ("2024-07-01", 9, None)


@pytest.mark.parametrize("few", [True, False])
def test_lookup_never_shuffles_the_store(spark, records, monkeypatch, few):
    monkeypatch.setattr(store, "FEW_KEYS", 1000 if few else 0)
    write(spark, records, [(f"k{i}", f"2024-01-{1 + i % 28:02d}", "{}") for i in range(200)])
    asked = spark.createDataFrame([(k,) for k in ("k1", "k20", "k27", "absent", "k1", None)], "key string")
    have, lack = store.lookup(asked, records, "2024-01-15")
    plan = plan_of(have)
    lines = plan.splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    side = lines[join + 1].index(":- ")
    right = next(i for i, x in enumerate(lines) if i > join and x[side:].startswith("+- "))
    assert "Exchange" in "".join(lines[join:right]) and "Exchange" not in "".join(lines[right:])
    assert "Exchange" not in plan_of(store.latest(spark, records))
    assert "SelectedBucketsCount" in plan
    if few:
        assert "SelectedBucketsCount: 8 out of 8" not in plan
    assert sorted(r.key for r in have.collect()) == ["k20", "k27"] and sorted(r.key for r in lack.collect()) == ["absent", "k1"]


# samples


def test_samples_have_n_rows_and_repeat(spark):
    df = spark.range(5000).select((F.col("id") % 1700).alias("hash"), F.col("id").alias("b"))
    once = sorted(map(tuple, IO.sample_rows(df, 300).collect()))
    assert len(once) == 300 and once == sorted(map(tuple, IO.sample_rows(df.repartition(7), 300).collect()))
    assert once != sorted(map(tuple, IO.sample_rows(df, 300, seed=1).collect()))
    assert set(once) <= set(map(tuple, IO.sample_rows(df, 400).collect()))
    assert IO.sample_rows(df, 0).count() == 0 and IO.sample_rows(df, 5000).count() == 5000 and IO.sample_rows(df, 9000).count() == 5000


def test_samples_of_rows_alike(spark):
    """A third of the rows are one row; n still holds."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"))
    for n in (1, 900, 1500, 2500):
        assert IO.sample_rows(df, n).count() == n
    assert IO.sample_rows(df.limit(0), 5).count() == 0


# counts


def test_counts_come_from_the_job_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None), (4, 0.5)], "id int, confidence double").repartition(3)
    # both are looked at by the scheduler's own count of jobs
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        counts = IO.write_counted(df, f"{tmp_path}/kept", F.col("confidence") >= 0.5, {"unknown": F.col("confidence").isNull()})
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        writes = [j for j in tracker.getJobIdsForGroup(group)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"rows": 4, "dropped": 2, "unknown": 1}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 4]
    # adaptive execution runs a shuffle's map side as a job of its own; nothing is computed twice
    assert len(writes) <= 2 and len(stages) <= 3


def test_small_tables_are_checked(spark):
    assert relational.is_small(spark.range(10)) and not relational.is_small(spark.range(relational.BROADCAST_ROWS + 1))


# branches


@pytest.mark.parametrize("small", [True, False])
def test_branches_against_prefixes(spark, monkeypatch, small):
    r = random.Random(4)
    code = lambda: ".".join([r.choice("CD") + str(r.randint(10, 13)), *(str(r.randint(1, 4)) for _ in range(r.randint(0, 3)))])
    rows = [("|".join(code() for _ in range(r.randint(1, 3))), i % 5) for i in range(200)] + [(None, 1), ("", 2), ("|", 3), (" C10.1 | D13", 4), ("C10.1", 7), ("C10.1", 7), (".5", 8)]
    branches = [code() for _ in range(12)] + ["C1", "", None, "C10.1"]
    monkeypatch.setattr(relational, "is_small", lambda df: small)
    df = spark.createDataFrame(rows, "codes string, key int").repartition(3)
    got = relational.in_branches(df, "codes", spark.createDataFrame([(b,) for b in branches], "branch string"))
    inside = lambda c, b: c == b or c.startswith(b + ".") or ("." not in b and c.split(".")[0].startswith(b))
    want = [x for x in rows if any(inside(c.strip(), b) for c in (x[0] or "").split("|") if c.strip() for b in branches if b)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["codes", "key"]
    assert 10 < len(want) < len(rows)
