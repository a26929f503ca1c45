"""Bounds on what is gathered or meets in one task, whatever the data."""

import numpy as np
from pyspark.sql import functions as F

from evigraph.llm import langid, topk


def test_junk_languages_are_bounded(spark):
    d = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the cat sat on the mat").otherwise("der hund ist in dem haus").alias("text"),
        F.when(F.col("id") % 20 > 1, F.when(F.col("id") % 2 == 0, "en").otherwise("de")).otherwise(F.concat(F.lit("junk"), "id")).alias("lang"),
    )
    assert langid.fit(d, languages=2).names == ["de", "en"]
    # equal numbers: the first by name
    assert langid.fit(d, languages=5).names[:2] == ["de", "en"] and len(langid.fit(d, languages=5).names) == 5
    some = langid.fit(d, languages=2, characters=1)
    assert some.names == ["de", "en"]
    got = langid.identify(d, some).filter("doc_id % 20 > 1").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got == 1.0


def test_sample_ends_at_its_share_of_characters(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "Classifier", lambda texts, langs, *a: taken.append((texts, langs)))
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc "), F.lit(25)).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    langid.fit(d.withColumn("text", F.concat("text", "doc_id")), characters=4000)
    texts, langs = taken[0]
    # 2000 characters for each of two languages; the text that passes the bound is the last
    assert set(langs) == {"a", "b"} and all(2000 <= sum(len(t) for t, x in zip(texts, langs) if x == k) < 2000 + 104 for k in "ab")


def test_one_id_with_very_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 64)
    monkeypatch.setattr(topk, "BLOCK", 4)
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 4))
    ids = [7] * 150 + [50, 100] + list(range(200, 348))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id bigint, embedding array<double>")
    w, want = np.floor(256 * v).astype(int), set()
    for q in (i for i in ids if i % 50 == 0):
        at = ids.index(q)
        best = sorted((-int(w[at] @ w[j]), ids[j]) for j in range(300) if ids[j] != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(rows).collect()} == want
