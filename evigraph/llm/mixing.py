"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a mean weight and a schedule, a piecewise-linear shape over training time 0..1.
Its share of all words follows from the mean weights (water-filling below the repeat limit), the
schedule is integrated to cumulative demand, and demand is inverted: a document that stands at
word c of its source's stream gets the time at which the source has asked for c words. Sorting
by that time, by range, is the training order.

Documents stand in the order of a hash of their ids. Running sums over a source are split by ranges
of that order, so a hot source is never one task's work: the rows of a range are summed by one window,
and the ranges' offsets by another over their totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import WORD, checkpointed, own_names, row_key

#: Shapes over training time, (time, relative weight), dealt to sources in turn: fading, steady, growing.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a schedule has asked for `share` (0..1) of its whole demand.

    Between knots the weight is linear, so demand is quadratic and its inverse has a closed form.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total = sum(areas)
    if total <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")
    out, before = F.lit(float(knots[-1][0])), total
    for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas))):
        before -= area
        left = F.greatest(share * F.lit(total) - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
        # 2c / (b + sqrt(b^2 + 2ac)) holds for a flat piece too
        step = F.when(left > 0, F.lit(2.0) * left / (F.lit(w0) + root)).otherwise(0.0)
        out = F.when(share * F.lit(total) < F.lit(before + area), F.lit(t0) + F.least(step, F.lit(t1 - t0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(source, source_size, target, turn): each source's words, and the words the mix takes from it.

    Sources stand by code point, null last, and get `weights` in turn. Targets share all words by
    weight but stop at max_repeats times the source; what is over is shared again by weight. Sorted
    by the level at which a source fills up, the full ones are a prefix, which running sums find.
    The work is on one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = by_source.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    full_first = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    everything = full_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("open", F.col("left") * F.col("weight") / F.col("weight_left") < F.col("cap"))
    )
    # among open rows the first has the largest weight left
    first_open = F.max(F.when(F.col("open"), F.struct("weight_left", "left"))).over(everything)
    s = s.withColumn("level", first_open)
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.weight_left")
    target = F.when(F.col("open"), share).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "turn", target.alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_repeats: int, schedules) -> DataFrame:
    """plan_mix() with the key (k1, k2) of rows alike in id, text and source."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    k1, k2 = row_key("doc_id", "text", "source")
    sizes = checkpointed(d.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2")))
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    targets = source_targets(sizes, weights, max_repeats)
    # stored, since a second run might cut the ranges elsewhere
    place = ["source", "order", "size", "text_hash"]
    rows = checkpointed(sizes.withColumn("order", order).repartitionByRange(*place).withColumn("range", F.spark_partition_id()))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target", "t.turn")
    inside = Window.partitionBy("source", "range").orderBy("order", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.range") == F.col("o.range"))).select("r.*", "o.range_start", "o.source_size", "o.target", "o.turn")
    want = F.floor("target").cast("long")
    start = F.col("range_start") + F.col("inside")

    def copy(k: int) -> Column:
        at = start + F.col("source_size") * k
        words = F.greatest(F.lit(0), F.least(F.col("size"), want - at)).cast("long")
        share = F.try_divide(at + words / 2, F.col("target"))
        time = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            time = F.when(F.col("turn") % len(schedules) == turn, invert_demand(share, knots)).otherwise(time)
        return F.struct(words.alias("words"), time.alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(max_repeats)]), lambda c: c["words"] > 0)
    rows = rows.withColumn("copies", copies)
    return rows.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, schedules=SCHEDULES) -> DataFrame:
    """One row a document: doc_id, text_hash, source, size, source_size, target, taken, copies.

    copies: array of (words, position), a copy of the document each, position its time 0..1. The
    words taken of a source are its target, rounded down: at most one document a source is cut.

    Null text and text without words: size 0, never taken. Null source: a source of its own. Null
    and repeated ids: each row counts for itself; rows alike in id, text and source are dealt in any
    order, which gives the same set of rows. Empty table: no rows. Other columns are not read.
    """
    rows = _planned(docs, id_col, text_col, source_col, weights, max_repeats, schedules)
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken", "copies")


def range_sorted(rows: DataFrame, *keys) -> DataFrame:
    """Rows in order of keys: partitions by range, each sorted."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def first_words(text: Column, words: Column) -> Column:
    """Text up to the end of its word number `words`, white space in between kept."""
    return F.regexp_replace(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), words.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, schedules=SCHEDULES) -> DataFrame:
    """The mix itself, in training order: a row of docs for each copy taken, all columns kept, whatever their names.

    A copy of which fewer words are taken ends after them. Documents not taken are gone, as are null
    texts and those without words. Rows alike in id, text and source are numbered, and each gets the
    copies of one of them. Null ids and sources: as in plan_mix(). Empty table: no rows.
    """
    k1, k2, number, copy, position = own_names(docs.columns, "k1", "k2", "number", "copy", "position")
    plan = _planned(docs, id_col, text_col, source_col, weights, max_repeats, schedules)
    # the keys are hashes, so that both sides are dealt out and sorted once
    alike = Window.partitionBy("k1", "k2").orderBy("k1")
    taken = plan.select("k1", "k2", F.row_number().over(alike).alias("number"), "copies").filter(F.size("copies") > 0)
    a, b = row_key(f"`{id_col}`", f"`{text_col}`", f"`{source_col}`")
    d = docs.withColumn(k1, a).withColumn(k2, b)
    d = d.withColumn(number, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))).alias("d")
    on = (F.col(f"d.{k1}") == F.col("p.k1")) & (F.col(f"d.{k2}") == F.col("p.k2")) & (F.col(f"d.{number}") == F.col("p.number"))
    text = F.col(f"`{text_col}`")
    rows = d.join(taken.alias("p"), on).select("d.*", F.explode("p.copies").alias(copy))
    cut = F.when(F.col(f"{copy}.words") < word_count(text), first_words(text, F.col(f"{copy}.words"))).otherwise(text)
    rows = rows.withColumn(text_col, cut).withColumn(position, F.col(f"{copy}.position"))
    return range_sorted(rows, position, F.col(f"`{id_col}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
