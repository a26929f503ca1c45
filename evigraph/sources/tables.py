"""Delimited and Parquet tables: reading with repair, conforming to a schema, writing."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evigraph.checkpoint import checkpointed
from evigraph.columns import own_names
from evigraph.workers import ship

#: Column that receives a row that does not fit the header.
CORRUPT = "_corrupt"


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out over all cores if it comes in fewer parts than these; one of more parts stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


@dataclass(frozen=True)
class Spec:
    """What a table must look like: wanted columns, other names for them, types, defaults, keys that may not be null."""

    wanted: Sequence[str] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    prefixes: Mapping[str, str] = field(default_factory=dict)
    required: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    not_null: Sequence[str] = ()


def snake(name: str) -> str:
    return name.strip().lstrip("﻿").lower().replace(" ", "_").replace("-", "_")


def normalize_names(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Snake-case names without a byte-order mark, then other names for the same replaced."""
    names = [snake(c) for c in df.columns]
    return df.toDF(*[(aliases or {}).get(n, n) for n in names])


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, case ignored."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def conform(df: DataFrame, spec: Spec) -> DataFrame:
    """Names, required columns, types (what does not fit is null), defaults for absent columns and nulls, keys without null."""
    df = normalize_names(df, spec.aliases)
    for target, prefix in spec.prefixes.items():
        if target not in df.columns and (found := next((c for c in df.columns if c.startswith(prefix)), None)):
            df = df.withColumnRenamed(found, target)
    require(df, spec.required)
    if spec.wanted:
        df = df.select(*[c for c in spec.wanted if c in df.columns])
    for c, kind in spec.types.items():
        if c in df.columns:
            value = F.col(c).try_cast(kind)
            df = df.withColumn(c, F.when(~F.isnan(value), value) if kind in ("double", "float") else value)
    for c, value in spec.defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value))
    return df.na.drop(subset=list(spec.not_null)) if spec.not_null else df


def _read_csv(spark: SparkSession, path: str, names: Sequence[str], **options) -> DataFrame:
    """All columns as text; CORRUPT holds a row of another length. Rows are parsed whole, whatever is asked of them."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "__bad"])
    df = spark.read.options(columnPruning=False, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", quote='"', escape='"', **options).schema(schema).csv(path)
    # Spark refuses to read the record of a bad row alone, so it is read with the first column
    record = F.concat(F.col("__bad"), F.coalesce(F.substring(F.col(f"`{names[0]}`"), 1, 0), F.lit("")))
    return df.withColumn(CORRUPT, record).drop("__bad")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", limit: int | None = None) -> DataFrame:
    """All columns as text, header first. Rows of another length stay, marked in CORRUPT."""
    header = spark.read.csv(path, sep=sep, header=True, inferSchema=False).schema
    df = _read_csv(spark, path, [f.name for f in header], sep=sep, header=True)
    return df if limit is None else df.limit(limit)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, text of rows that do not)"""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def header_after_comment(lines: Sequence[str], sep: str, tokens: Sequence[str], fallback: Sequence[str]) -> list[str]:
    """Column names from the comment line that names all of tokens, else the fallback."""
    for line in lines:
        names = [x.strip() for x in line.lstrip("﻿").lstrip("# ").rstrip("\n").split(sep)]
        if line.lstrip("﻿").startswith("#") and set(tokens) <= set(names):
            return names
    return list(fallback)


def read_commented(spark: SparkSession, path: str, fallback: Sequence[str], sep: str = "\t", tokens: Sequence[str] | None = None, peek: int = 400) -> DataFrame:
    """A delimited file whose header hides among leading "#" lines; lines that start with "#" are no rows.

    A compressed file is one partition, so rows are dealt out anew right after reading, to as many
    partitions as their size asks for under adaptive execution.
    """
    head = [r[0] for r in spark.read.text(path).limit(peek + 1).collect()]
    names = header_after_comment(head, sep, tokens if tokens is not None else fallback[:2], fallback)
    df = _read_csv(spark, path, names, sep=sep, comment="#")
    if names and not any(line.startswith("#") for line in head):
        df = df.filter(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) != names[0])
    return df.hint("rebalance") if path.endswith(".gz") else df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold nothing but nulls, found in one pass."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[i]])


def read_matching_columns(spark: SparkSession, path: str, patterns: Sequence[str], sep: str = "\t") -> DataFrame | None:
    """Columns, by name, whose upper-case name contains a pattern; rows that hold something; None without a file."""
    try:
        df = read_delimited(spark, path, sep).drop(CORRUPT)
    except AnalysisException:
        return None
    keep = sorted(c for c in df.columns if any(p in c.upper() for p in patterns))
    return df.select(*[F.col(f"`{c}`") for c in keep]).na.drop("all")


def read_present(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, only the wanted columns that it has; all if it has none of them."""
    df = spark.read.parquet(path)
    keep = [c for c in columns or () if c in df.columns]
    return df.select(*keep) if keep else df


def load_catalog(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables that exist; others are left out."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{folder}/{n}")
        except AnalysisException:
            continue
    return out


def largest_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """Path of the largest file of a name anywhere below a folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
        return files.agg(F.max_by("path", F.struct("length", "path"))).first()[0]
    except AnalysisException:
        return None


def sampled(df: DataFrame, fraction: float | None, seed: int = 42) -> DataFrame:
    """A seeded sample; everything by default."""
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly n rows, or all if there are no more: those of the least hashes of the seed and the columns `keys`, by default all.

    The same rows and seed give the same sample, however they are dealt out. A first pass over the
    hashes drops those far above the n-th least, so that no task sorts many more than n, and rows
    themselves are only filtered. Rows alike in `keys` are taken or left in any choice.
    """
    if n <= 0:
        return df.limit(0)
    (name,) = own_names(df.columns, "hash")
    rows = df.withColumn(name, F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys or df.columns])))))
    total = df.count()
    if total <= n:
        return df
    hashes, wanted = rows.select(name), n + 8 * math.sqrt(n) + 16
    while True:
        # the first eight of the 32 digits are spread evenly
        bound = min(0xFFFFFFFF, int(wanted / total * (1 << 32)))
        near = hashes.filter(F.substring(name, 1, 8) <= f"{bound:08x}")
        if bound == 0xFFFFFFFF or near.count() >= n:
            break
        wanted *= 2
    least = near.orderBy(name).limit(n)
    last = least.agg(F.max(name)).first()[0]
    ties, alike = least.filter(F.col(name) == last).count(), hashes.filter(F.col(name) == last).count()
    if ties == alike:
        return rows.filter(F.col(name) <= last).drop(name)
    return rows.filter(F.col(name) < last).unionByName(rows.filter(F.col(name) == last).limit(ties)).drop(name)


def write_counted(df: DataFrame, path: str, keep: Column, counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Writes the rows that meet `keep` as Parquet, and counts in the same job: rows, dropped, and those of all rows that meet each of `counts`.

    A condition that is null is not met.
    """
    met = {k: F.coalesce(c, F.lit(False)) for k, c in (counts or {}).items()}
    keep, seen = F.coalesce(keep, F.lit(False)), Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~keep).alias("dropped"), *[F.count_if(c).alias(k) for k, c in met.items()])
    watched.filter(keep).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_sorted_csv(df: DataFrame, path: str, *order) -> None:
    """CSV files with a header, in order over all files."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_nested_json(df: DataFrame, path: str, key: str, name: str = "items") -> None:
    """One JSON object a key, its rows as a list: for keys whose rows fit in memory, as an object must. Rows of larger groups are written as lines."""
    rest = [c for c in df.columns if c != key]
    df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)).write.mode("overwrite").json(path)


def glue_documents(batches: Iterator[pa.RecordBatch], edges: Mapping[int, tuple[bool, bool]]) -> Iterator[pa.RecordBatch]:
    """Lines of the documents of one range, from (range, head, item) in order; edges tells whether its first document began before it and whether its last goes on after it."""
    last = last_range = None
    for batch in batches:
        out = []
        for part, head, item in zip(*(c.to_pylist() for c in batch.columns)):
            if head == last:
                out[-1:] = [out[-1] + ","] if out else [","]
            else:
                out += ["]}"] if last is not None else []
                out += [head] if last is not None or not edges[part][0] else [","]
            out.append(item)
            last, last_range = head, part
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    if last is not None and not edges[last_range][1]:
        yield pa.RecordBatch.from_arrays([pa.array(["]}"], pa.string())], names=["value"])


def write_documents(df: DataFrame, path: str, key: str, *order: str, name: str = "items") -> None:
    """One JSON document a key, {"key": ..., "items": [rows in order]}, each row on a line, with its key; files in order of their names are a stream of documents.

    Rows are dealt out by range of key and order, so a key of any size passes from one file into the
    next and no task gathers one. The driver sees the first and last key of each range alone. A null
    key is a document of its own; rows alike in key and order stand in any order, in one range.
    Empty table: no documents.
    """
    ship(__name__)
    opening = F.to_json(F.struct(F.col(f"`{key}`").alias(key)), {"ignoreNullFields": "false"})
    head = F.concat(F.left(opening, F.length(opening) - 1), F.lit(f",{json.dumps(name)}:["))
    place = [F.col(f"`{c}`") for c in (key, *order)]
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    # stored, since a second run might cut the ranges elsewhere
    rows = checkpointed(df.repartitionByRange(*place).sortWithinPartitions(*place).select(F.spark_partition_id().alias("range"), head.alias("head"), item.alias("item"), F.monotonically_increasing_id().alias("at")))
    ends = rows.groupBy("range").agg(F.min_by("head", "at").alias("first"), F.max_by("head", "at").alias("last")).orderBy("range").collect()
    firsts, lasts = [e["first"] for e in ends], [e["last"] for e in ends]
    edges = {e["range"]: (k > 0 and lasts[k - 1] == e["first"], k + 1 < len(ends) and firsts[k + 1] == e["last"]) for k, e in enumerate(ends)}
    rows.select("range", "head", "item").mapInArrow(lambda batches: glue_documents(batches, edges), "value string").write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of write_documents(), by `schema`, with _at, in whose order they were written."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_at"))
    rows = lines.filter(F.col("value").rlike(r"^\{.*\},?$"))
    return rows.select(F.from_json(F.rtrim("value", F.lit(",")), schema).alias("r"), "_at").select("r.*", "_at")


def append_records(df: DataFrame, path: str, saved_at: str = "saved_at") -> None:
    """Adds records to a store, stamped with the time."""
    (df if saved_at in df.columns else df.withColumn(saved_at, F.current_timestamp())).write.mode("append").parquet(path)


def latest_records(spark: SparkSession, path: str, key: str, saved_at: str = "saved_at") -> DataFrame:
    """The last record of each key of a store."""
    df = spark.read.parquet(path)
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), saved_at).alias("r")).select("r.*")
