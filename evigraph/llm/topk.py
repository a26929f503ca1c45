"""Exact top-k by inner product without random access.

Each dimension of a block of vectors is a list sorted by that component; a query reads it from the
end that adds most to its score. Lists are read in step, to growing depths; each step adds only the
entries that it reads. A vector's lower bound adds to what was read of it the least that its unread
components can add, its upper bound the most. Vectors whose upper bound is below the k-th best lower
bound of every query are dropped and read no further. A query stops reading when few vectors outside
its k best can still qualify; their scores are then resolved in full, in whole numbers.

Queries and vectors meet on a grid: each group of queries visits each cell of vectors once, both of
bounded size. The first cell is visited first; its k-th best score of a query is the bar from which
all other cells start, and a task raises it from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import checkpointed, ship

ship(__name__)

#: Vectors whose lists are read together, and queries that read them together.
BLOCK, TOGETHER = 2048, 512
#: Components of all vectors of a cell, and of all queries of a group: 16 MB and 2 MB.
CELL, GROUP = 1 << 21, 1 << 18
#: Components up to this size are multiplied as floats, without error; vectors with larger ones go apart, as Python integers.
PLAIN = 1 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Reader:
    """Reads the sorted lists of a block in step for some queries; `read` holds what was read of each query's score for each vector."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray):
        self.n, self.depth = len(vectors), 0
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], 0)
        self.vectors, self.read = vectors, np.zeros((len(queries), self.n))

    def step(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Reads on to `depth` entries of each list; lower and upper bounds, queries by vectors."""
        n = self.n
        # positive weights read from the large end, negative ones from the small end
        high, low = self.place >= n - depth, self.place < depth
        self.read += self.up @ np.where(high & (self.place < n - self.depth), self.vectors, 0).T
        self.read += self.down @ np.where(low & (self.place >= self.depth), self.vectors, 0).T
        self.depth = depth
        if depth >= n:
            return self.read, self.read
        rest_up, rest_down = (~high).astype(np.float64).T, (~low).astype(np.float64).T
        upper = self.read + (self.up * self.sorted[n - depth]) @ rest_up + (self.down * self.sorted[depth - 1]) @ rest_down
        lower = self.read + (self.up * self.sorted[0]) @ rest_up + (self.down * self.sorted[-1]) @ rest_down
        return lower, upper

    def keep(self, queries: np.ndarray, vectors: np.ndarray) -> None:
        """Goes on for these queries and vectors only; places in the lists stay."""
        self.up, self.down = self.up[queries], self.down[queries]
        self.place, self.vectors, self.read = self.place[vectors], self.vectors[vectors], self.read[np.ix_(queries, vectors)]


def first_k(at: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query place, ties to the smaller vector."""
    # ~score falls as score rises, and has no overflow
    order = np.lexsort((vec, ~score, at))
    at, vec, score = at[order], vec[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], vec[keep], score[keep]


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bar: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query place, id, score) of the k best of a block that reach the bar; raises the bar to the k-th best known."""
    reader, n = Reader(queries, vectors), len(vectors)
    waiting, left, depth = np.arange(len(queries)), np.arange(n), max(1, n // 4)
    while len(waiting) and len(left):
        lower, upper = reader.step(depth)
        own = query_ids[waiting, None] == ids[None, left]
        if len(left) >= k:
            kth = np.partition(np.where(own, -np.inf, lower), len(left) - k, axis=1)[:, len(left) - k]
            bar[waiting] = np.maximum(bar[waiting], kth)
        may = (upper >= bar[waiting, None]) & ~own
        ready = (may.sum(1) <= 4 * k) | (depth >= n)
        at, which = np.nonzero(may & ready[:, None])
        at, which = waiting[at], left[which]
        score = np.einsum("ij,ij->i", queries[at].astype(np.int64), vectors[which].astype(np.int64))
        good = score >= bar[at]
        yield first_k(at[good], ids[which[good]], score[good], k)
        go, some = ~ready, may[~ready].any(0)
        reader.keep(np.flatnonzero(go), np.flatnonzero(some))
        waiting, left, depth = waiting[go], left[some], min(n, depth * 2)


def apart(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, scale: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query place, id, score) of the k best of components as they came, by Python integers; scores beyond a long are its least or greatest number."""

    def whole(x: np.ndarray) -> np.ndarray:
        # a float of this size is whole
        return np.array([[math.floor(scale * c) if abs(c) < 1e18 else scale * int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)

    v = whole(vectors)
    for i, q in enumerate(whole(queries)):
        some = np.flatnonzero(ids != query_ids[i])
        score = [min(MOST, max(LEAST, s)) for s in (v[some] * q).sum(1)] if len(some) else []
        yield first_k(np.full(len(some), i), ids[some], np.array(score, np.int64), k)


def best_of_cell(k: int, scale: int):
    """For cogrouped applyInArrow: query rows and vector rows of a cell to (query_id, vec_id, score), k each."""

    def matrix(table: pa.Table) -> np.ndarray:
        flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in table.column("v").chunks)])
        return flat.reshape(table.num_rows, -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            as_came = matrix(left), matrix(right)
            with np.errstate(over="ignore"):
                queries, vectors = (np.floor(scale * x) for x in as_came)
            query_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            bar = left.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)
            most = PLAIN / math.sqrt(max(1.0, queries.shape[1] / 8192))
            plain_q, plain_v = (np.abs(x).max(1) < most for x in (queries, vectors))

            def add(places, rows):
                found.extend((places[at], vec, score) for at, vec, score in rows)

            for q in np.split(np.flatnonzero(plain_q), range(TOGETHER, int(plain_q.sum()), TOGETHER)):
                v, own = np.flatnonzero(plain_v), bar[q]
                for s in range(0, len(v), BLOCK):
                    b = v[s : s + BLOCK]
                    add(q, best_of_block(queries[q], query_ids[q], vectors[b], ids[b], k, own))
            for q, v in ((~plain_q, np.ones(len(ids), bool)), (plain_q, ~plain_v)):
                if q.any() and v.any():
                    add(np.flatnonzero(q), apart(as_came[0][q], query_ids[q], as_came[1][v], ids[v], k, scale))
            at, vec, score = first_k(*(np.concatenate(x) for x in zip(*found)), k)
            found = [(query_ids[at], vec, score)]
        return pa.table([pa.array(x, pa.int64()) for x in found[0]], names=["query_id", "vec_id", "score"])

    return best


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, is_query=None, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest integer inner product, itself left out.

    Components become floor(scale * x). is_query(id column) picks the queries, by default all ids
    that 50 divides. Ties go to the smaller vec_id; with fewer other rows all are returned. Scores are
    exact; one beyond the range of a long is the least or greatest long.

    Null vectors and ids, and vectors with null, NaN or infinite components or no component take no
    part. Vectors of another number of components than the query's are not compared with it. Rows
    that repeat an id with the same vector count once; ids with several vectors are ranked by each,
    and a query never meets its own id. Empty table: no rows. Other columns are not read.
    """
    is_query = is_query or (lambda c: c % 50 == 0)
    spark, x = vectors.sparkSession, F.col(f"`{vector_col}`")
    usable = F.col(f"`{id_col}`").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"))
    rows = checkpointed(rows.distinct())
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = n["width"] or 1
    # bounded in bytes, and enough cells for all cores
    cell = min(max(1, CELL // width), max(BLOCK, math.ceil(n["n"] / spark.sparkContext.defaultParallelism)))
    cells, groups = max(1, math.ceil(n["n"] / cell)), max(1, math.ceil(n["q"] / max(1, GROUP // width)))
    # by id and vector, so that an id with very many vectors fills no cell alone
    in_cell = F.pmod(F.xxhash64("id", "v"), F.lit(cells)).alias("cell")
    in_group = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(groups)).alias("group")
    size = F.size("v").alias("width")
    queries = rows.filter(is_query(F.col("id"))).select("id", "v", size, in_group)
    others = rows.select("id", "v", size, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"), in_cell)
    keys = ("width", "group", "cell")

    def meet(q: DataFrame, v: DataFrame) -> DataFrame:
        # both sides come from the same rows; these are columns of their own
        q = q.select(*[F.col(c).alias(c) for c in q.columns])
        return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(best_of_cell(k, scale), "query_id bigint, vec_id bigint, score bigint")

    zero = F.lit(0).cast("bigint")
    found = checkpointed(meet(queries.select("*", zero.alias("cell"), F.lit(float("-inf")).alias("bar")), others.filter("cell = 0")))
    if cells > 1:
        bars = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
        bars = bars.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("least")).alias("bar"))
        known = queries.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        known = known.select("*", F.explode(F.sequence(zero + 1, F.lit(cells - 1).cast("bigint"))).alias("cell"))
        found = found.unionByName(meet(known, others.filter("cell > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
