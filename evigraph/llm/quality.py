"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes good (1), bad (0) or abstains (null) on a document. Documents are counted by pattern
of votes, at most 3 to the number of rules. Expectation-maximisation over these counts estimates how
often each rule is right on good and on bad documents, and the share of good ones; the counted patterns
reach the driver, which are as few for any corpus. A document is kept if its posterior probability of
being good is at least one half.

The model takes rules as independent once it is known whether a document is good, so each rule judges
a signal of its own: no two look at the same measure.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import SPACES, WORD, checkpointed, let
from evigraph.llm.votes import fit_patterns

SYMBOLS = "#*$%&|<>"
#: What ends a sentence, also in scripts that have marks of their own.
ENDS = ".!?。！？؟।"


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of `width` words that the array holds twice or more.

    Windows are hashed in place. Where some are equal, sorting (hash, position) puts equals side by
    side; the starts of all that have an equal neighbour, in order, cover min(width, gap) words each.
    """

    def hashes(ws):
        starts = F.sequence(F.lit(0), F.size(ws) - width)
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*[ws[i + k] for k in range(width)]).alias("h"), i.alias("i")))

    def with_equals(hs):
        def cover(s):
            none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
            before = F.concat(none, F.slice(s, F.lit(1), F.size(s) - 1))
            after = F.concat(F.slice(s, F.lit(2), F.size(s)), none)
            marked = F.zip_with(F.zip_with(s, before, lambda a, b: F.struct(a.alias("a"), (a["h"] == b["h"]).alias("e"))), after, lambda m, c: F.when(m["e"] | (m["a"]["h"] == c["h"]), m["a"]["i"]))
            return let(F.array_sort(F.filter(marked, lambda i: i.isNotNull())), gaps)

        def gaps(p):
            following = F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.lit(None).cast("int")))
            return F.aggregate(F.zip_with(p, following, lambda a, b: F.least(F.lit(width), b - a)), F.lit(0).cast("long"), lambda t, x: t + x)

        same = F.size(F.array_distinct(F.transform(hs, lambda x: x["h"]))) == F.size(hs)
        return F.when(same, F.lit(0).cast("long")).otherwise(let(F.array_sort(hs), cover))

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(let(words, hashes), with_equals))


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_ends, n_letters, n_letterless (long). Null text: all 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(signs: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    measures = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), F.size(F.filter(ws, lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_letterless")),
    )
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        measures.alias("m"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (F.size(lines)).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        count(ENDS).alias("n_ends"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )
    return rows.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "n_lines", "n_capitals", "n_ends", "n_letters", "m.n_letterless")


def default_rules() -> dict[str, Column]:
    """Votes over text_measures(): 1 good, 0 bad, null abstains between the two, or where the text is too short to tell."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")

    def vote(good: Column, bad: Column, applies: Column) -> Column:
        return F.when(applies & good, 1).when(applies & bad, 0)

    some = words >= 10
    return {
        "length": vote(words >= 50, words < 20, some),
        "word_length": vote((chars >= 3 * words) & (chars <= 8 * words), (2 * chars < 5 * words) | (chars > 12 * words), some),
        "symbols": vote(F.col("n_symbols") * 20 <= words, F.col("n_symbols") * 4 > words, some),
        "capitals": vote(F.col("n_capitals") * 10 <= chars, F.col("n_capitals") * 4 > chars, some),
        "letters": vote(F.col("n_letters") * 20 >= 17 * chars, F.col("n_letters") * 4 < 3 * chars, some),
        "letterless": vote(F.col("n_letterless") * 20 <= words, F.col("n_letterless") * 20 > 3 * words, some),
        "ends": vote((F.col("n_ends") * 60 >= words) & (F.col("n_ends") * 4 <= words), F.col("n_ends") * 2 > words, words >= 20),
        "lines": vote(F.col("n_dup_lines") * 20 <= lines, F.col("n_dup_lines") * 5 > lines, lines >= 4),
        "repeats": vote(F.col("n_repeat_words") * 50 <= words, F.col("n_repeat_words") * 10 > words, words >= 50),
    }


def log_odds(names, model: Mapping) -> Column:
    """Log of P(good | votes) / P(bad | votes); abstentions say nothing."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for n in names:
        g, b = model["good"][n], model["bad"][n]
        total = total + F.when(F.col(n) == 1, F.lit(math.log(g / b))).when(F.col(n) == 0, F.lit(math.log((1 - g) / (1 - b)))).otherwise(0.0)
    return total


def fit_votes(votes: DataFrame, names, *, rounds: int = 25, prior: float = 0.8, floor: float = 0.02) -> dict:
    """Maximum-likelihood model of the votes, {prior, good: {rule: P(1 | good)}, bad: {rule: P(1 | bad)}}.

    The start says that rules are mostly right, which fixes the meaning of "good"; each rule stays
    on that side (it votes 1 at least as often on good as on bad documents) and within `floor` of 0
    and 1. Without documents the start is the model.
    """
    names = list(names)
    patterns = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns.sort(key=lambda r: [-1 if r[n] is None else r[n] for n in names])
    table = np.array([[-1 if r[n] is None else r[n] for n in names] for r in patterns]).reshape(len(patterns), len(names))
    prior, good, bad = fit_patterns(table, [r["n"] for r in patterns], rounds=rounds, prior=prior, floor=floor)
    return {"prior": prior, "good": dict(zip(names, good.tolist())), "bad": dict(zip(names, bad.tolist()))}


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """One row a document: its measures, base_failed, p_good (posterior) and kept.

    base_failed: fewer than 10 words, or more than a fifth of the words repeated; such documents are
    never kept. Others are kept if p_good is at least one half; the model is fitted on all of these.

    Null and empty text: no words, so base_failed. Null and repeated ids: each row counts for itself.
    Empty table: no rows. Other columns are not read.
    """
    rules = default_rules() if rules is None else dict(rules)
    measures = checkpointed(text_measures(docs, id_col, text_col))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    votes = measures.withColumns({f"vote_{n}": v.cast("int") for n, v in rules.items()})
    names = [f"vote_{n}" for n in rules]
    model = fit_votes(votes.filter(~base), names)
    p = 1 / (1 + F.exp(-log_odds(names, model)))
    return votes.withColumn("base_failed", base).withColumn("p_good", p).withColumn("kept", ~base & (p >= 0.5)).drop(*names)
