"""Hard-negative mining by inner product, with coordinate pruning.

Two searches over the same vectors: an anchor's positives are its best rows of the same label; its
hard negatives are the best rows of other labels whose scores lie in a band below each positive's.

Vectors are kept in buckets of like length, each with a sorted list per coordinate of its normalised
vectors. A score that must reach a bar asks for an angle of at most `beta` to the anchor; a bucket
whose longest vector cannot reach the bar is skipped. In the others, an anchor looks at its focus
coordinates, the largest of its own direction: a vector at an angle within `beta` has a value there
within a range that follows from the anchor's (angles obey the triangle inequality). The ranges are
stretches of the sorted lists; the vectors in all of them are verified in whole numbers. The bar
rises as results come in.

Anchors and vectors meet on a grid of groups of anchors of like bar, and cells of vectors of like
length, both of bounded size; pairs of a group and a cell that cannot reach the bar are not made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import checkpointed, ship
from evigraph.operators.relational import lookup_join

ship(__name__)

#: Vectors of a bucket, and focus coordinates of an anchor.
BUCKET, FOCUS = 1024, 4
#: Components of all vectors of a cell, and of all anchors of a group.
CELL, GROUP = 1 << 21, 1 << 18
#: Components up to this size are multiplied as floats, without error; vectors with larger ones go apart, as Python integers.
PLAIN = 1 << 20
#: Ratio of the lengths, and of the bars, that share cells and groups.
LIKE = 1.25
#: Slack of the ranges, well above the rounding of angles.
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1
Rows = tuple[np.ndarray, np.ndarray]


class Bucket:
    """Vectors of like length with their coordinate lists."""

    def __init__(self, vectors: np.ndarray, length: np.ndarray):
        self.longest = float(length.max())
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.asfortranarray(np.take_along_axis(unit, self.order, 0))
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(unit))[:, None], 0)

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Places of vectors that may have this cosine or more to a direction; None for all."""
        if cosine <= 0:
            return None
        alpha, beta = np.arccos(np.clip(direction[focus], -1, 1)), math.acos(min(1.0, cosine))
        low, high = np.cos(np.minimum(np.pi, alpha + beta)) - SLACK, np.cos(np.maximum(0, alpha - beta)) + SLACK
        ranges = [(np.searchsorted(self.sorted[:, f], a), np.searchsorted(self.sorted[:, f], b, "right"), f) for f, a, b in zip(focus, low, high)]
        ranges.sort(key=lambda r: r[1] - r[0])
        (a, b, f), rest = ranges[0], ranges[1:]
        found = self.order[a:b, f]
        for a, b, f in rest:
            if b - a < len(self.order):
                at = self.place[found, f]
                found = found[(at >= a) & (at < b)]
        return found


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> Rows:
    """The k first by falling score, ties to the smaller id."""
    if len(ids) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    # ~score falls as score rises, and has no overflow
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


class Bands:
    """What an anchor looks for: for each band [low, high] of scores its k best rows. The bar is what a new row must reach."""

    def __init__(self, bands: list[tuple[int, int]], k: int):
        self.bands, self.k = bands, k
        none = np.zeros(0, np.int64)
        self.found: list[Rows] = [(none, none) for _ in bands]
        self.bar = min((low for low, _ in bands), default=MOST)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        bars = []
        for i, (low, high) in enumerate(self.bands):
            fit = (scores >= low) & (scores <= high)
            if fit.any():
                self.found[i] = best(*(np.concatenate(x) for x in zip(self.found[i], (ids[fit], scores[fit]))), self.k)
            full = len(self.found[i][1]) >= self.k
            bars.append(int(self.found[i][1][-1]) if full else low)
        self.bar = min(bars, default=MOST)


def whole(x: np.ndarray, scale: int) -> list[list[int]]:
    """Components as Python integers; a float of this size is whole."""
    return [[math.floor(scale * c) if abs(c) < 1e18 else scale * int(c) for c in row] for row in x.tolist()]


def search(anchors: np.ndarray, wanted: list[Bands], anchor_ids: np.ndarray, anchor_labels: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, scale: int) -> None:
    """Offers each anchor the rows of the same label, or of others, that may reach its bar; a row never meets its own id."""
    with np.errstate(over="ignore"):
        a, v = np.floor(scale * anchors), np.floor(scale * vectors)
    most = PLAIN / math.sqrt(max(1.0, a.shape[1] / 8192))
    plain_a, plain_v = np.abs(a).max(1) < most, np.abs(v).max(1) < most
    length = np.sqrt((v[plain_v] ** 2).sum(1))
    places = np.flatnonzero(plain_v)[np.argsort(-length, kind="stable")]
    length = -np.sort(-length)
    norms = np.sqrt((np.where(plain_a[:, None], a, 0) ** 2).sum(1))
    directions = np.where(plain_a[:, None], a, 0) / np.where(norms > 0, norms, 1)[:, None]
    focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
    # positives are looked for among the label's own vectors
    parts = [(np.flatnonzero(anchor_labels == x), np.flatnonzero(labels[places] == x)) for x in np.unique(anchor_labels)] if same else [(np.arange(len(a)), np.arange(len(places)))]
    for who, which in parts:
        for s in range(0, len(which), BUCKET):
            at = places[which[s : s + BUCKET]]
            block, bucket = v[at], Bucket(v[at], length[which[s : s + BUCKET]])
            for i in who[plain_a[who]]:
                reach = norms[i] * bucket.longest
                if wanted[i].bar > reach * (1 + 1e-9):
                    continue
                some = bucket.candidates(directions[i], focus[i], wanted[i].bar / reach * (1 - 1e-9) if reach > 0 else 0.0)
                mine = at if some is None else at[some]
                scores = ((block if some is None else block[some]) @ a[i]).astype(np.int64)
                good = (scores >= wanted[i].bar) & (ids[mine] != anchor_ids[i]) & ((labels[mine] == anchor_labels[i]) == same)
                if good.any():
                    wanted[i].offer(ids[mine[good]], scores[good])
    for i in range(len(a)):
        rest = np.flatnonzero((~plain_v if plain_a[i] else np.ones(len(v), bool)) & (ids != anchor_ids[i]) & ((labels == anchor_labels[i]) == same))
        if len(rest):
            (q,) = whole(anchors[i : i + 1], scale)
            scores = [min(MOST, max(LEAST, sum(x * y for x, y in zip(q, row)))) for row in whole(vectors[rest], scale)]
            wanted[i].offer(ids[rest], np.array(scores, np.int64))


def matrix(table: pa.Table) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in table.column("v").chunks)])
    return flat.reshape(table.num_rows, -1)


def coded(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Labels of several columns as numbers, equal where the labels are."""
    codes = pa.chunked_array([c for x in columns for c in x.cast(pa.string()).chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    return np.split(codes, np.cumsum([len(x) for x in columns])[:-1])


def long_array(columns: list[list], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns], names=names)


def positives_of_cell(k: int, scale: int):
    """For cogrouped applyInArrow: anchors and vectors of a cell to (anchor, id, score), k each."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            anchor_labels, labels = coded(left.column("label"), right.column("label"))
            wanted = [Bands([(LEAST, MOST)], k) for _ in range(left.num_rows)]
            search(matrix(left), wanted, left.column("id").to_numpy(), anchor_labels, matrix(right), right.column("id").to_numpy(), labels, True, scale)
            for anchor, w in zip(left.column("anchor").to_pylist(), wanted):
                ids, scores = w.found[0]
                for c, x in zip(out, (np.full(len(ids), anchor), ids, scores)):
                    c.append(x)
        return long_array(out, ["anchor", "id", "score"])

    return find


def negatives_of_cell(k: int, scale: int):
    """For cogrouped applyInArrow: anchors, each with its bands, and vectors of a cell to (anchor, band, id, score), k each."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            anchor_labels, labels = coded(left.column("label"), right.column("label"))
            bands = left.column("bands").to_pylist()
            wanted = [Bands([(b["low"], b["high"]) for b in x], k) for x in bands]
            search(matrix(left), wanted, left.column("id").to_numpy(), anchor_labels, matrix(right), right.column("id").to_numpy(), labels, False, scale)
            for anchor, own, w in zip(left.column("anchor").to_pylist(), bands, wanted):
                for b, (ids, scores) in zip(own, w.found):
                    for c, x in zip(out, (np.full(len(ids), anchor), np.full(len(ids), b["band"]), ids, scores)):
                        c.append(x)
        return long_array(out, ["anchor", "band", "id", "score"])

    return find


def dealt(rows: DataFrame, by: list[str], most: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a place among the parts of their kind; (by, parts)): as many parts as hold `most` rows each."""
    parts = checkpointed(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).withColumn(f"{name}s", F.ceil(F.col("rows") / most).cast("bigint")).drop("rows"))
    return lookup_join(rows, parts, by, "inner").withColumn(name, F.pmod(F.xxhash64(F.lit(7), "anchor"), F.col(f"{name}s"))), parts


def numbers(n: Column) -> Column:
    """0 .. n - 1"""
    return F.sequence(F.lit(0).cast("bigint"), n - 1)


def mine_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, is_anchor=None, positives: int = 5, k: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Components become floor(scale * x); a score is the integer inner product with the anchor. An
    anchor's positives are its first `positives` other rows of the same label, by falling score,
    ties to the smaller id. For each, the first k rows of other labels whose score is from `lowest`
    to `highest` percent of the positive's. Fewer rows are returned where there are no more; an
    anchor without positives, and a positive without negatives, has none. is_anchor(id column)
    picks the anchors, by default all ids that 50 divides.

    Rows with a null id, label or vector, with null, NaN or infinite components, or with none take
    no part. Vectors of another number of components than the anchor's are not compared with it.
    Rows that repeat an id with the same label and vector count once; other rows of one id are rows
    of their own, which never meet each other. Scores are exact; one beyond the range of a long is
    the least or greatest long. Empty table: no rows. Other columns are not read.
    """
    is_anchor = is_anchor or (lambda c: c % 50 == 0)
    x = F.col(f"`{vector_col}`")
    usable = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.transform(x, lambda c: c.cast("double")).alias("v"))
    rows = rows.withColumn("anchor", F.xxhash64("id", "label", "v")).withColumn("width", F.size("v"))
    # beyond this size a float is whole
    q = F.transform("v", lambda c: F.when(F.abs(c) < 1e15, F.floor(c * scale).cast("double")).otherwise(c * scale))
    rows = rows.withColumn("length", F.least(F.sqrt(F.aggregate(q, F.lit(0.0), lambda t, c: t + c * c)), F.lit(1e300)))
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "label", "v"])
    rows = checkpointed(rows)
    # vectors of a cell, and of a group, of this width; cells are fewer only where there are enough for all cores
    share = max(BUCKET, math.ceil(rows.count() / rows.sparkSession.sparkContext.defaultParallelism))
    cell, group = (F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("width"))) for most in (CELL, GROUP))
    cell = F.least(cell, F.lit(share))
    anchors = rows.filter(is_anchor(F.col("id")))

    # positives: anchors and vectors of one label
    mine, groups = dealt(anchors, ["width", "label"], group, "group")
    theirs, cells = dealt(rows, ["width", "label"], cell, "cell")
    keys = ["width", "label", "group", "cell"]
    left = lookup_join(mine.drop("groups"), cells, ["width", "label"], "inner").withColumn("cell", F.explode(numbers(F.col("cells"))))
    right = lookup_join(theirs.drop("cells"), groups, ["width", "label"], "inner").withColumn("group", F.explode(numbers(F.col("groups"))))
    left, right = left.select("id", "v", "anchor", *keys), right.select(*[F.col(c).alias(c) for c in ("id", "v", *keys)])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(positives_of_cell(positives, scale), "anchor bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    found = checkpointed(found.withColumn("band", place.cast("bigint")).filter(F.col("band") <= positives))

    # bands of scores, in whole numbers: ceil(lowest %) to floor(highest %); below zero there is none
    s = F.col("score").cast("decimal(20,0)")
    low, high = F.ceil(s * lowest / 100), F.floor(s * highest / 100)
    bands = found.withColumn("low", low.cast("bigint")).withColumn("high", high.cast("bigint")).filter("low <= high")
    bands = bands.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("bands"), F.min("low").alias("bar"))
    seekers = anchors.join(bands, "anchor")

    # an anchor's bar over its length is how long a vector has to be
    def like(c: Column) -> Column:
        return F.when(c > 0, F.floor(F.log(c) / math.log(LIKE))).otherwise(-10_000).cast("int")

    seekers = seekers.withColumn("needs", F.coalesce(F.try_divide(F.col("bar").cast("double"), F.col("length")), F.lit(0.0))).withColumn("bar_kind", like(F.col("needs")))
    seekers, _ = dealt(checkpointed(seekers), ["width", "bar_kind"], group, "group")
    sized, _ = dealt(rows.withColumn("length_kind", like(F.col("length"))), ["width", "length_kind"], cell, "cell")
    reach = sized.groupBy("width", "length_kind", "cell").agg(F.max("length").alias("longest"))
    needs = seekers.groupBy("width", "bar_kind", "group").agg(F.min("needs").alias("needs"))
    pairs = checkpointed(reach.join(needs, "width").filter(F.col("longest") * (1 + 1e-6) >= F.col("needs")).drop("longest", "needs"))
    keys = ["width", "bar_kind", "group", "length_kind", "cell"]
    left = lookup_join(seekers.drop("groups"), pairs, ["width", "bar_kind", "group"], "inner").select("id", "label", "v", "anchor", "bands", *keys)
    right = lookup_join(sized.drop("cells"), pairs, ["width", "length_kind", "cell"], "inner").select(*[F.col(c).alias(c) for c in ("id", "label", "v", *keys)])
    hard = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(negatives_of_cell(k, scale), "anchor bigint, band bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id"))
    hard = hard.withColumn("rank", place).filter(F.col("rank") <= k).select("anchor", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    out = found.select("anchor", "band", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(hard, ["anchor", "band"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
