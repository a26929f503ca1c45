"""Best match by a weighted similarity: whole texts, sorted words, sets of words and partial alignments.

The score of two texts, 0 to 100, is made of indel ratios, 200 x the longest common subsequence over
the sum of both lengths:

* `whole`: of the texts; `sorted`: of their words in order; `set`: the best of the shared words against
  the shared words with the rest of either side, and of those two; 100 if one side has no rest.
* `partial`: of the shorter text and the best piece of the longer one, no longer than the shorter.
* Lengths within 1.5 of each other: the greatest of whole, 0.95 sorted and 0.95 set. Otherwise whole, p
  x partial, and 0.95 p x the partial score of sorted words, which is 100 if any word is shared; p is
  0.9, or 0.6 if one text is more than 8 times as long.

Candidates come from two-character grams, each word between blanks, so that the order of words does not
matter. Of a text of n characters that reaches a ratio s with another text, or with a piece of it, at
most `lost(n, s)` grams are not found there; so they share one of its first lost + 1 grams in any one
order (two more are lost at the ends of a piece). Only the side that is found in the other needs such a
prefix, rare grams first; of the other side all grams are looked up. A shared word alone gives one
fixed score, so of the keys that share a word only the least of each length is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.functions import text as T
from evigraph.operators.relational import best_per_key, lookup_join
from evigraph.workers import ship

ship(__name__)

# Weights and limits of the score.
WORDS, PIECE, LONG_PIECE, NEAR, FAR = 0.95, 0.9, 0.6, 1.5, 8.0
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
#: The least threshold for which texts of any length share a gram.
LEAST_THRESHOLD = 82.0


def common(places: dict[str, int], n: int, other: str) -> int:
    """Longest common subsequence with a text of n characters, given the bits of each character's places."""
    row = full = (1 << n) - 1
    for c in other:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return n - (row & full).bit_count()


def places_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def ratio(a: str, b: str) -> float:
    return 200.0 * common(places_of(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """Ratio of the shorter text and the best piece of the longer, no longer than it; either way round if they are as long."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not m:
        return 0.0 if n else 100.0
    if a in b:
        return 100.0
    places, best = places_of(a), 0.0
    for s in range(1 - m, n):
        piece = b[max(0, s) : s + m]
        if 2 * min(m, len(piece)) / (m + len(piece)) * 100 > best:
            best = max(best, 200.0 * common(places, m, piece) / (m + len(piece)))
    if m == n:
        places = places_of(b)
        for s in range(1 - m, n):
            piece = a[max(0, s) : s + m]
            best = max(best, 200.0 * common(places, m, piece) / (m + len(piece)))
    return best


def set_ratio(a: list[str], b: list[str]) -> float:
    """Of the words of two texts, each sorted and told once."""
    both = [w for w in a if w in b]
    rest_a, rest_b = (" ".join(w for w in x if w not in both) for x in (a, b))
    if both and not (rest_a and rest_b):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if both else 0
    whole_a, whole_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    apart = len(rest_a) + len(rest_b) - 2 * common(places_of(rest_a), len(rest_a), rest_b)
    best = 100.0 - 100.0 * apart / (whole_a + whole_b)
    if both:
        best = max(best, *(100.0 - 100.0 * (gap + len(r)) / (shared + w) for r, w in ((rest_a, whole_a), (rest_b, whole_b))))
    return best


def weighted(a: str, b: str) -> float:
    """The weighted similarity of two texts; 0 if one is empty."""
    if not a or not b:
        return 0.0
    words = [sorted(w for w in BLANKS.split(x) if w) for x in (a, b)]
    in_order = [" ".join(w) for w in words]
    once = [sorted(set(w)) for w in words]
    best, far = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if far < NEAR:
        return max(best, WORDS * ratio(*in_order), WORDS * set_ratio(*once))
    p = PIECE if far <= FAR else LONG_PIECE
    best = max(best, p * partial(a, b))
    if set(once[0]) & set(once[1]):
        return max(best, WORDS * p * 100.0)
    best = max(best, WORDS * p * partial(*in_order))
    return max(best, WORDS * p * partial(*map(" ".join, once))) if once != words else best


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (l, r) to (l, r, score)."""
    for b in batches:
        score = [weighted(x, y) for x, y in zip(b.column("l").to_pylist(), b.column("r").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("l"), b.column("r"), pa.array(score, pa.float64())], names=["l", "r", "score"])


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, BLANKS.pattern), lambda w: w != "")


def word_grams(c: Column) -> Column:
    """Two-character pieces of each word between blanks, numbered where they repeat."""
    pieces = F.flatten(F.transform(words_of(c), lambda w: T.let(F.concat(F.lit(" "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))))))
    return T.let(pieces, lambda a: F.transform(a, lambda x, i: F.concat(x, F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x)).cast("string"))))


def lost(n: Column, share: float) -> Column:
    """Grams of a text of n characters that may be missing from one that reaches the ratio `share` with it.

    With c characters in common, the other has at most 2 c / share - n; each character not in common
    costs the text two grams, each of the other's one. The most over all possible c.
    """
    other = lambda c: F.floor(2 * c / F.lit(share) - n + 1e-9).cast("int")
    most = F.array_max(F.transform(F.sequence(F.lit(1), n), lambda c: F.when(other(c) >= c, 2 * (n - c) + other(c) - c).otherwise(0)))
    # of words alone, shared words may lack the rest of one side
    return F.greatest(most, F.floor(2 * n * (1 - share) / (2 - share) + 1e-9).cast("int"))


def sides(df: DataFrame, key: str, name: str) -> DataFrame:
    """(text, form, n, grams): a text as it is, and with each word told once if that differs."""
    d = df.select(F.col(f"`{key}`").alias(name)).filter(F.length(name) > 0).distinct()
    once = F.array_join(F.array_distinct(words_of(F.col(name))), " ")
    d = d.select(name, F.explode(F.array_distinct(F.array(F.col(name), once))).alias("form")).filter(F.size(words_of(F.col("form"))) > 0)
    single = F.transform(F.array_distinct(F.split("form", "")), lambda c: F.concat(F.lit("1"), c))
    return checkpointed(d.select(name, F.length(name).alias("n"), F.length("form").alias("form_n"), word_grams(F.col("form")).alias("grams"), single.alias("single")))


def prefixes(side: DataFrame, other: DataFrame, name: str, whole: float, piece: float) -> DataFrame:
    """(text, n, gram): of each form as many grams, those rare on the other side first, as cannot all be missing."""
    counts = checkpointed(other.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("seen")))
    rows = side.select(name, "n", "form_n", F.explode("grams").alias("gram"))
    rows = lookup_join(rows, counts, "gram").groupBy(name, "n", "form_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram"))).alias("g"))
    size = F.greatest(lost(F.col("form_n"), whole), lost(F.col("form_n"), piece) + 2) + 1
    many = rows.select(name, "n", F.explode(F.slice("g", F.lit(1), size)).alias("p")).select(name, "n", "p.gram")
    # a text of one character is looked for as it is
    return many.unionByName(side.filter("form_n = 1").select(name, "n", F.explode("single").alias("gram")))


def best_weighted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 85.0) -> DataFrame:
    """(left_key, right_key, score): for each distinct text of left the best one of right that scores at least threshold, ties to the smaller.

    Nothing is missed at thresholds of 82 and more. Null, empty and blank texts match nothing; texts
    without a match are absent.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError("threshold must be at least 82")
    whole, piece = threshold / 100, min(1.0, threshold / (100 * PIECE))
    a, b = sides(left, left_key, "l"), sides(right, right_key, "r")
    every = {name: d.select(name, "n", F.explode(F.concat("grams", "single")).alias("gram")) for name, d in (("l", a), ("r", b))}
    # texts of one length class are found by the left side's prefix, pieces by that of the shorter
    first = prefixes(a, b, "l", whole, piece).withColumnRenamed("n", "l_n").join(every["r"].withColumnRenamed("n", "r_n"), "gram")
    first = first.filter((F.col("l_n") < NEAR * F.col("r_n")) & (F.col("r_n") <= FAR * F.col("l_n")))
    by_words = min(1.0, threshold / (100 * WORDS))
    second = prefixes(b, a, "r", by_words, piece).withColumnRenamed("n", "r_n").join(every["l"].withColumnRenamed("n", "l_n"), "gram")
    second = second.filter((F.col("r_n") < NEAR * F.col("l_n")) & (F.col("l_n") <= FAR * F.col("r_n")))
    pairs = first.select("l", "r").unionByName(second.select("l", "r")).distinct()
    found = pairs.mapInArrow(scored, "l string, r string, score double").filter(F.col("score") >= threshold)
    shared = 100 * WORDS * PIECE
    if threshold <= shared:
        tokens = {name: d.select(name, "n").distinct().select(name, "n", F.explode(F.array_distinct(words_of(F.col(name)))).alias("word")) for name, d in (("l", a), ("r", b))}
        least = tokens["r"].groupBy("word", F.col("n").alias("r_n")).agg(F.min("r").alias("r"))
        longer, shorter = F.greatest("n", "r_n"), F.least("n", "r_n")
        fixed = tokens["l"].join(least, "word").filter((longer >= NEAR * shorter) & (longer <= FAR * shorter)).select("l", "r", F.lit(shared).alias("score"))
        found = found.unionByName(fixed)
    best = best_per_key(found, "l", [F.desc("score"), F.col("r")])
    return best.select(F.col("l").alias(left_key), F.col("r").alias(right_key), "score")
