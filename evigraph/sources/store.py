"""A store of records by key: the last write wins, records have a time, payloads may have any shape.

The store is a bucketed table: every write adds files to the buckets of its keys, and only the written
rows are shuffled. Reading the last record of each key, and joining the store with requested keys, need
no exchange of the store, since each task reads one bucket. Lookups of a few keys read their buckets
only. compact() rewrites the table with the last records alone, bucket by bucket. Payloads are VARIANT:
records of different shapes side by side, read by typed paths.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.relational import is_small

#: Requested keys up to this many are looked up by name, which leaves out the buckets that have none of them.
FEW_KEYS = 1000


def create_store(spark: SparkSession, name: str, path: str, key_type: str = "string", buckets: int = 64) -> None:
    """An empty store (key, saved_at, payload, write_no) in a folder that all executors share."""
    spark.sql(f"CREATE TABLE {name} (key {key_type}, saved_at TIMESTAMP, payload VARIANT, write_no BIGINT) USING parquet OPTIONS (path '{path}') CLUSTERED BY (key) INTO {int(buckets)} BUCKETS")


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def upsert(rows: DataFrame, name: str, key: Column, payload: Column, saved_at: Column | None = None) -> None:
    """Adds records; those of a key that is there take its place. payload: JSON text.

    Null keys and payloads that are no JSON are left out. Of records of one key in one write the one
    saved last stands, then the greater text.
    """
    spark = rows.sparkSession
    saved_at = F.current_timestamp() if saved_at is None else saved_at
    new = rows.select(key.alias("key"), saved_at.cast("timestamp").alias("saved_at"), payload.alias("payload")).filter("key IS NOT NULL AND try_parse_json(payload) IS NOT NULL")
    new = new.groupBy("key").agg(F.max(F.struct("saved_at", "payload")).alias("r")).select("key", "r.saved_at", F.parse_json("r.payload").alias("payload"), F.lit(time.time_ns()).alias("write_no"))
    # dealt out as the table is, so that a write adds a file to a bucket
    new.repartition(buckets_of(spark, name), "key").write.insertInto(name)


def latest(spark: SparkSession, name: str, keys: Column | None = None) -> DataFrame:
    """(key, saved_at, payload): the last record of each key; keys: which ones, as a condition on the column key."""
    store = spark.table(name)
    store = store if keys is None else store.filter(keys)
    last = store.groupBy("key").agg(F.max_by(F.struct("saved_at", "payload"), "write_no").alias("r"))
    return last.select("key", "r.saved_at", "r.payload")


def lookup(requested: DataFrame, name: str, since=None) -> tuple[DataFrame, DataFrame]:
    """(records of requested keys saved at or after `since`, requested keys without one). requested: (key), repeats and nulls ignored.

    A few keys are looked up by name. More are dealt out to the store's buckets; a store is never shuffled.
    """
    spark = requested.sparkSession
    keys = requested.select("key").filter("key IS NOT NULL").distinct()
    named = None
    if is_small(keys):
        some = [r["key"] for r in keys.limit(FEW_KEYS + 1).collect()]
        named = F.col("key").isin(some) if len(some) <= FEW_KEYS else None
    records = latest(spark, name, named)
    if since is not None:
        records = records.filter(F.col("saved_at") >= F.lit(since).cast("timestamp"))
    both = keys.hint("shuffle_merge").join(records, "key", "left")
    return both.filter("saved_at IS NOT NULL"), both.filter("saved_at IS NULL").select("key")


def compact(spark: SparkSession, name: str, path: str) -> None:
    """Rewrites the store in another folder with the last record of each key; the old table goes once the new one is whole."""
    new = f"{name}_compacted"
    spark.sql(f"CREATE TABLE {new} LIKE {name} USING parquet LOCATION '{path}'")
    number = buckets_of(spark, name)
    if buckets_of(spark, new) != number:
        raise ValueError("the copy has other buckets")
    rows = latest(spark, name).withColumn("write_no", F.lit(time.time_ns()))
    rows.write.insertInto(new)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")


def field(path: str, kind: str) -> Column:
    """A typed field of the payload; null where it is absent or has no such value."""
    return F.try_variant_get("payload", path, kind)
