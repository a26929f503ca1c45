"""A corpus pipeline in five stages, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. There is no SQL for the whole: language identification and the Jaccard join are not
relational; tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import jaccard, langid, line_dedup, mixing, packing
from evigraph.llm.common import checkpointed, own_names
from evigraph.llm.queries import tokenizer_path

#: Documents are rejected whose best language leads by less than in all but this share of the training sample's texts of their size.
LANGUAGE_LOSS = 0.02
#: Slices of training time within which packing may bring documents together; between them the mix's order stays.
TIME_SLICES = 64


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars brought into line with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null and letterless texts, junk, languages that no document teaches.

    Null and repeated ids: each row is judged by its text. Without a document that names its language
    nothing can be recognised, and nothing stays. Empty table: no rows.
    """
    rows = langid.identify(docs, langid.fit(docs, loss=LANGUAGE_LOSS))
    return rows.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later occurrences of three-line windows out of the texts; every row stays.

    Null texts stay null; a text may end up empty. Rows alike in id and text count as one document,
    rows that share only the id are ordered by a hash of the text. Empty table: no rows.
    """
    return with_length(line_dedup.dedup_lines(docs)).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that with the least id, and of like ids the least hash of the text.

    Of rows alike in id and text one stays. Rows that share only the id are documents of their own.
    Rows without an id all stay, as do texts without words. Empty table: no rows.
    """
    found = jaccard.join_near(docs).filter("first").select("doc_id", "text_hash").distinct()
    (key,) = own_names(docs.columns, "hash")
    rows = docs.withColumn(key, F.xxhash64("text")).alias("d").join(found.alias("f"), (F.col("d.doc_id") == F.col("f.doc_id")) & (F.col(f"d.{key}") == F.col("f.text_hash")), "left_semi")
    kept = rows.dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in training order: a row for each copy of a document that is taken, the last one of a source cut.

    Texts without words and null ones are never taken. Null source: a source of its own. Null and
    repeated ids: each row counts for itself. Empty table: no rows.
    """
    return with_length(mixing.mix_documents(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their token ids.

    docs is the mix, whose order is that of its stored rows; sequences are numbered by slice of it.
    Null and empty texts are their end token alone; null and repeated ids: each row is packed. Empty
    table: no rows.
    """
    return packing.pack_documents(packing.with_slices(docs, TIME_SLICES), tokenizer_path(), slice_col="slice")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it has stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
