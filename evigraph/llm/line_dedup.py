"""Line dedup by overlapping windows of three lines (DataFrame functions only).

Every window of consecutive lines is hashed. The first occurrence of each window, by document id
and then position, is found by one aggregation, which combines before it shuffles, so that a window
in a third of all documents costs one row a task. First occurrences return to their documents; the
windows of a document that are not among them are later occurrences, and the lines they cover go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import identity, let, own_names

NOT_BLANK = r"[^\x20\x09-\x0D]"


def window_hashes(text: Column, width: int) -> Column:
    """Array of (pos, h1, h2): a 128-bit hash of each window of `width` lines that holds a word."""

    def windows(lines):
        def one(i):
            inside = [lines[i + k] for k in range(width)]
            return F.struct(i.alias("pos"), F.xxhash64(*inside).alias("h1"), F.xxhash64(F.lit(5), *inside).alias("h2"))

        starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
        some = F.filter(starts, lambda i: F.concat(*[lines[i + k] for k in range(width)]).rlike(NOT_BLANK))
        return F.transform(some, one)

    return let(F.split(text, "\n", -1), windows)


def without_lines(lines: Column, gone: Column) -> Column:
    """Lines whose positions are not in `gone`."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(kept, lambda i: lines[i])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3) -> DataFrame:
    """docs with repeated lines taken out of the text, and the columns n_lines and n_removed (long).

    Lines end at line feeds. A window is `width` lines in a row, at least one of them with a word. Of
    equal windows anywhere the first stays (smaller id, null first, then smaller position); all lines
    under later ones go. Windows are judged on the input. A document shorter than `width` lines has no
    window and stays as it is; a document may end up with an empty text, its row stays.

    Null text: stays null, n_lines 0. Rows alike in id and text count as one document and come out
    alike; rows that share only the id are ordered by a hash of the text. Empty table: no rows. Columns
    named n_lines or n_removed are replaced, all others kept.
    """
    ids = docs.select(*identity(id_col, text_col), F.col(text_col).alias("text"))
    windows = ids.filter(F.col("text").isNotNull()).select("doc_id", "text_hash", F.inline(window_hashes(F.col("text"), width)))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("f")).select("f.*")
    own = first.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("first"))

    rest = docs.drop("n_lines", "n_removed")
    text, (key, kept, gone) = F.col(f"`{text_col}`"), own_names(rest.columns, "hash", "first", "gone")
    d = rest.withColumn(key, F.xxhash64(text)).alias("d")
    rows = d.join(own.alias("o"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("o.doc_id")) & (F.col(f"d.{key}") == F.col("o.text_hash")), "left").select("d.*", F.col("o.first").alias(kept))
    later = F.array_except(F.transform(window_hashes(text, width), lambda w: w["pos"]), F.coalesce(kept, F.array().cast("array<int>")))
    covered = F.array_distinct(F.flatten(F.transform(later, lambda p: F.array(*[p + k for k in range(width)]))))
    rows = rows.withColumn(gone, covered)
    cut = F.when(F.size(gone) > 0, let(F.split(text, "\n", -1), lambda lines: F.array_join(without_lines(lines, F.col(gone)), "\n"))).otherwise(text)
    n_lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    out = rows.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(n_lines).cast("long")).withColumn("n_removed", F.when(text.isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return out.withColumn(text_col, cut).drop(key, kept, gone)
