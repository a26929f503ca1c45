"""The pipeline's stages, each on what the one before has kept."""

import random
import statistics

from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import jaccard, packing
from tests.llm.test_operators import dedup_by_hand, ids_of, word_list


def test_stages(spark, docs, corpus, tmp_path):
    from tokenizers import Tokenizer

    from evigraph.llm.queries import tokenizer_path

    docs = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", docs.doc_id)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    read, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, "unused")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = read.collect()
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    gone = {r[0] for r in corpus} - set(ids["language_id"])
    assert gone == {130, 131, 133, 134}
    want = dedup_by_hand([(r.doc_id, r.text) for r in kept["language_id"]])
    before = {r.doc_id: r.text for r in kept["language_id"]}
    for r in kept["line_dedup"]:
        assert r.text == want[r.doc_id, before[r.doc_id]][0] and r.n_chars == len(r.text)
    assert len(kept["line_dedup"]) == len(kept["language_id"])
    rows = spark.createDataFrame(kept["line_dedup"], docs.schema)
    least = {r.class_id for r in jaccard.join_near(rows).collect()}
    assert sorted(ids["jaccard_join"], key=str) == sorted(least, key=str)
    total = sum(len(word_list(r.text)) for r in kept["jaccard_join"])
    taken = sum(len(word_list(r.text)) for r in kept["mixing"])
    assert total - 10 <= taken <= total
    t = Tokenizer.from_file(tokenizer_path())
    assert sum(r.length for r in kept["packing"]) == sum(len(ids_of(t, r.text)) for r in kept["mixing"])


def test_unknown_languages_and_junk_are_rejected(spark):
    syllables = {"aa": ["ba", "do", "ki"], "bb": ["zu", "pe", "ri"], "cc": ["ço", "lé", "na"], "dd": ["mü", "sta", "gi"]}

    def text(r, parts, n):
        return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))

    rows = [(i, text(random.Random(i), syllables["abcd"[i % 4] * 2], 10 + i % 60), "abcd"[i % 4] * 2) for i in range(400)]
    r = random.Random(1)
    letters = [chr(x) for x in range(97, 123)]
    bad = ["これは日本語の文章です。今日はとても良い天気ですから、公園に散歩に行きましょう。", "Это русский текст, который написан для проверки языка.", text(r, ["wx", "yv", "fh"], 60), text(r, letters, 200), " ".join(f"{r.getrandbits(128):032x}" for _ in range(9))]
    rows += [(1000 + k, t, None) for k, t in enumerate(bad)] + [(2000, "12 34", "aa"), (2001, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "unused").collect()}
    assert not {i for i in kept if i >= 1000}
    assert len(kept) >= 0.96 * 400


def test_sequences_follow_the_curriculum(spark, tmp_path):
    rows = [(i, f"zz{i % 7} " + " ".join(f"w{(i * 13 + k) % 97}" for k in range(60)), "ax", f"s{i % 3}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "unused")
    mixed.write.parquet(f"{tmp_path}/mix")
    stored = spark.read.parquet(f"{tmp_path}/mix")
    for read in (stored, corpus_pipeline.checkpointed(mixed)):
        out = corpus_pipeline.packing_stage(spark, read, "unused").collect()
        source = {i: x for i, _, _, x, _ in rows}
        order = sorted({r.sequence_id for r in out})
        rank = {s: k / len(order) for k, s in enumerate(order)}
        mean = {x: statistics.fmean(rank[r.sequence_id] for r in out if source[r.doc_id] == x) for x in ("s0", "s1", "s2")}
        assert mean["s0"] < 0.47 and abs(mean["s1"] - 0.5) < 0.08 and mean["s2"] > 0.54


def test_slices_follow_the_stored_order(spark, tmp_path):
    docs = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") % 5)
    docs.write.parquet(f"{tmp_path}/rows")
    for read in (spark.read.parquet(f"{tmp_path}/rows"), docs):
        out = packing.with_slices(read, 8)
        assert out.columns == ["id", "x", "slice"]
        assert {r.id: r.slice for r in out.collect()} == {i: i * 8 // 1000 for i in range(1000)}
    assert packing.with_slices(docs.limit(0), 8).count() == 0
