"""Names found in whole texts, held against lists of all phrases and spans; what the literature plan shuffles."""

import random

from pyspark.sql import functions as F

from evigraph import article_queries
from evigraph import lexicons as L
from evigraph.functions import text as T
from evigraph.operators import mining
from evigraph.plans import literature

NAMES = ("tnf", "hla", "hla-dqa1", "dqa1", "il-6", "a b", "a-b", "b c d e", "b c d e f", "ulcerative colitis", "colitis", "a_b", "é", "x,y", "il--6", "b")


def texts(n: int = 200) -> list[str]:
    random.seed(3)
    bits = [*NAMES, "TNF", "HLA-DQA1", "c", "d", "e", "f", "ulcerative", "ßx", "İl-6", "o'b", "x:colitis-y"]
    return ["", "-", *["".join(random.choice(bits) + random.choice([" ", " ", "-", ", ", ".", "'", ":", "  ", "_", "\n"]) for _ in range(random.randint(1, 9))) for _ in range(n)]]


def test_names_in(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    spans = F.flatten(F.transform(T.word_phrases(F.col("t"), 1), T.linked_spans))
    phrases = F.flatten(F.transform(T.word_phrases(F.col("t"), 4), lambda x: F.array_union(F.array(x), T.linked_spans(x))))
    names = F.array(*map(F.lit, NAMES))
    got = rows.select("t", T.names_in(F.col("t"), names, longest=0).alias("a"), T.names_in(F.col("t"), names).alias("b"), F.array_intersect(names, spans).alias("x"), F.array_intersect(names, phrases).alias("y")).collect()
    assert all(r.a == r.x and r.b == r.y for r in got), [r for r in got if r.a != r.x or r.b != r.y][:3]
    assert sum(len(r.b) for r in got) > 100


def test_word_parts(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    wanted = ("tnf", "colitis", "ulcerative colitis", "a b", "b", "dqa1")
    parts = F.flatten(F.transform(T.word_phrases(F.col("t"), 2), lambda p: F.array_union(F.array(p), F.split(p, r"[-',:]"))))
    got = rows.select("t", T.word_parts(F.col("t"), wanted).alias("a"), F.array_intersect(F.array(*map(F.lit, wanted)), parts).alias("x")).collect()
    assert all(sorted(r.a) == sorted(r.x) for r in got), [r for r in got if sorted(r.a) != sorted(r.x)][:3]


def test_cue_patterns(spark):
    said = [w for ps in L.CUES.values() for p in ps for w in (p.replace(r"\b", "").replace(r"\w+", "ed").replace(r"\s*", " "), "x" + p.replace(r"\b", ""))]
    said += ["xradio sensitized", "chemotherapy", "xchemo", "RISK  factor", "knock-down", "Upregulated", "ſilenced", "mrna", "genes", "xgenes", "éinhibits", "cups / day"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for name, patterns in L.CUES.items():
        assert L.cue(name).count(r"\b(?:") >= 1
        assert rows.filter(F.col("t").rlike(L.cue(name)) != F.col("t").rlike("(?iU)" + "|".join(patterns))).count() == 0


def test_no_word_is_shuffled(spark, monkeypatch):
    stored = []
    keep = lambda df: stored.append(df) or df
    for m in (literature, mining):
        monkeypatch.setattr(m, "checkpointed", keep)
    none = "array<string>"
    p = spark.createDataFrame([("1", "Caffeine intake increased TNF gene.", "", [], [], "Human", [])], f"pmid string, title string, abstract string, mesh_terms {none}, mesh_detail array<struct<name: string, ui: string, is_major: boolean>>, primary_species string, species_tags {none}")
    found, _, _ = literature.analyze(p, L.compound_lexicon(spark, ["caffeine"]), article_queries.aliases(spark))
    assert [r.gene for r in found.collect()] == ["TNF"]
    # no table of the words of all sentences is made
    assert not any("[word#" in df._jdf.queryExecution().optimizedPlan().toString() for df in stored)


def test_papers_are_analysed_once(spark, monkeypatch):
    calls = []
    plain = literature.article_sentences
    monkeypatch.setattr(literature, "article_sentences", lambda p: calls.append(1) or plain(p))
    article_queries.article_stats(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
