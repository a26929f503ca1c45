"""Lookups, ranking, rollups, merges and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.columns import own_names
from evigraph.functions import text as T

#: Lookup tables up to this many rows and bytes of text are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a table may be broadcast, by its checked rows and bytes. Counting runs its plan: pass what is stored or literal."""
    one = table.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).first()
    return one["rows"] <= BROADCAST_ROWS and (one["bytes"] or 0) <= BROADCAST_BYTES


def lookup_join(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    """Joins a lookup table, broadcast only if its checked size allows."""
    return df.join(F.broadcast(table) if is_small(table) else table, on, how)


def top_k(df: DataFrame, by, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank."""
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def best_per_key(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order."""
    (rank,) = own_names(df.columns, "rank")
    return top_k(df, keys, order, 1, rank).drop(rank)


def priority_union(*ranked: DataFrame, keys, order: Sequence[Column] = ()) -> DataFrame:
    """Rows of several tables of the same columns; of a key only those of the first table that has it, of these the first in order."""
    (place,) = own_names(ranked[0].columns, "place")
    rows = ranked[0].withColumn(place, F.lit(0))
    for i, df in enumerate(ranked[1:], 1):
        rows = rows.unionByName(df.withColumn(place, F.lit(i)))
    return best_per_key(rows, keys, [F.col(place), *order]).drop(place)


def fill_absent(derived: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """derived, and those rows of manual whose key, case ignored, derived lacks."""
    (own,) = own_names(manual.columns, "key")
    have = derived.select(F.lower(key).alias(own)).distinct()
    return derived.unionByName(manual.join(have, F.lower(manual[key]) == F.col(own), "left_anti"), allowMissingColumns=True)


def ordered_union(ids: Sequence[DataFrame], key: str, pos: str) -> DataFrame:
    """Distinct keys of several ranked lists, each at its first place: (key, list_no, pos)."""
    rows = ids[0].select(key, F.lit(0).alias("list_no"), pos)
    for i, df in enumerate(ids[1:], 1):
        rows = rows.unionByName(df.select(key, F.lit(i).alias("list_no"), pos))
    return rows.groupBy(key).agg(F.min(F.struct("list_no", pos)).alias("f")).select(key, "f.*")


def restrict(df: DataFrame, subset: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in subset; all rows if there is no subset or it is empty."""
    if subset is None:
        return df
    keys = subset.select(key).distinct()
    (own,) = own_names(df.columns, "key")
    rows = df.join(keys.select(F.col(key).alias(own)), F.col(key) == F.col(own), "left")
    empty = subset.agg((F.count(F.lit(1)) == 0).alias("empty")).scalar()
    return rows.filter(F.col(own).isNotNull() | empty).drop(own)


def split_by_store(requested: DataFrame, store: DataFrame, key: str, saved_at: str, since) -> tuple[DataFrame, DataFrame]:
    """(found in the store and saved at or after since, remaining).

    Records are dealt out over all shuffle partitions by key, and are one row a key before they are
    joined: Spark would merge partitions by their compressed bytes, of which sorted ids have few, and
    then sort very many rows in one task.
    """
    parts = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh = store.filter(F.col(saved_at) >= since).select(key).repartition(parts, key).distinct()
    return requested.join(fresh, key, "left_semi"), requested.join(fresh, key, "left_anti")


def evidence_rollup(df: DataFrame, keys, code: Column, direct: Column, score: Column, pubmed: Column) -> DataFrame:
    """One row an edge, null keys kept: has_direct, codes (distinct, sorted, piped), score, evidence_count, pubmed_count."""
    return df.groupBy(*keys).agg(
        F.bool_or(direct).alias("has_direct"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(code), F.lit("")))), "|").alias("codes"),
        F.max(score).alias("score"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.sum(pubmed).alias("pubmed_count"),
    )


def explode_synonyms(df: DataFrame, id_col: str, name_col: str, lists: Sequence[str]) -> DataFrame:
    """(id, key, kind): the name itself ("canonical") and each piped synonym that differs ("synonym:<column>"); distinct, nulls and blanks dropped."""
    base = df.filter(F.col(id_col).isNotNull() & F.col(name_col).isNotNull())
    name = T.normalize_key(F.col(name_col))
    rows = [F.array(F.struct(name.alias("key"), F.lit("canonical").alias("kind")))]
    for c in lists:
        keys = F.filter(F.transform(T.list_tokens(F.col(c)), lambda x: F.lower(T.strip(x))), lambda x: x != "")
        kind = F.lit(f"synonym:{c.lower()}").alias("kind")
        rows.append(F.transform(F.filter(keys, lambda x: x != name), lambda x: F.struct(x.alias("key"), kind)))  # noqa: B023
    return base.select(F.col(id_col).alias("id"), F.inline(F.concat(*rows))).filter(F.col("key") != "").distinct()


def in_branches(df: DataFrame, codes: str, branches: DataFrame, branch: str = "branch") -> DataFrame:
    """Rows one of whose piped codes lies in one of the branches, each row once.

    A code such as C18.452.394 lies in the branches C18, C18.452 and itself; a branch may also end
    within the first part, as C1 does. A code's ancestors are told apart in its row and looked up by
    one equi-join; rows are known by a number of their own, so that those alike stay apart. Null
    codes and branches, and empty ones, match nothing.
    """
    (row, key) = own_names(df.columns, "row", "key")
    known = branches.select(F.col(branch).alias(key)).filter(F.length(key) > 0).distinct()

    def ancestors(code: Column) -> Column:
        parts = F.split(code, r"\.")
        first = F.transform(F.sequence(F.lit(1), F.length(parts[0])), lambda n: F.substring(parts[0], F.lit(1), n))
        lower = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
        return F.concat(first, F.coalesce(lower, F.array().cast("array<string>")))

    tokens = F.filter(F.transform(T.list_tokens(F.col(f"`{codes}`")), T.strip), lambda c: F.length(F.split(c, r"\.")[0]) > 0)
    keys = F.array_distinct(F.flatten(F.transform(tokens, ancestors)))
    if is_small(known):
        # only what hits leaves a row, and a row leaves once
        rows = df.withColumn(row, F.monotonically_increasing_id())
        return lookup_join(rows.withColumn(key, F.explode(keys)), known, key, "left_semi").dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in df.columns])
    stored = checkpointed(df.withColumn(row, F.monotonically_increasing_id()))
    hit = stored.select(row, F.explode(keys).alias(key)).join(known, key, "left_semi").select(row).distinct()
    return stored.join(hit, row, "left_semi").drop(row)


def keep_matching_else_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition; all rows if none does."""
    met = F.coalesce(condition, F.lit(False))
    none = df.agg((F.count_if(met) == 0).alias("none")).scalar()
    return df.filter(met | none)
