"""Entity matching: exact variants, fuzzy join, and the cascade of both with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.functions import text as T
from evigraph.operators.relational import best_per_key, lookup_join
from evigraph.operators.weighted import best_weighted


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: one minus edit distance over the longer length, of the texts or of their sorted words, whichever is more."""
    def score(x, y):
        return 100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))

    return F.greatest(score(a, b), score(sorted_tokens(a), sorted_tokens(b)))


def grams(c: Column) -> Column:
    """Array of the two-character pieces of a text with a blank at either end, numbered where they repeat."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))

    def numbered(p):
        g = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))
        return T.let(g, lambda a: F.transform(a, lambda x, i: F.concat(x, F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x)).cast("string"))))

    return T.let(padded, numbered)


def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 85.0) -> DataFrame:
    """(left_key, right_key, score) of all pairs of distinct texts that score at least threshold.

    Texts within d edits share one of their first 2 d + 1 grams in any one order; rare grams come
    first here, so that only texts that share a rare gram are compared. It misses nothing at
    thresholds of 60 and more. Null and empty texts match nothing.
    """
    if threshold < 60:
        raise ValueError("threshold must be at least 60")

    def forms(df, key, name):
        d = df.select(F.col(key).alias(name)).filter(F.length(key) > 0).distinct()
        return d.select(name, F.explode(F.array_distinct(F.array(F.col(name), sorted_tokens(F.col(name))))).alias("form"))

    share = threshold / 100
    sides = []
    for df, key, name in ((left, left_key, "l"), (right, right_key, "r")):
        f = forms(df, key, name)
        sides.append((name, f.withColumn("g", grams(F.col("form")))))
    counts = checkpointed(sides[1][1].select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    prefixes = []
    for name, f in sides:
        g = lookup_join(f.select(name, "form", F.explode("g").alias("gram")), counts, "gram")
        ordered = g.groupBy(name, "form").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
        edits = F.floor((1 - share) / share * F.length("form") + 1e-9).cast("int")
        prefixes.append(ordered.select(name, F.explode(F.slice("g", F.lit(1), 2 * edits + 1)).alias("p"), F.length("form").alias(f"{name}_n")).select(name, f"{name}_n", F.col("p.gram").alias("gram")))
    near = F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * share - 1e-9
    pairs = prefixes[0].join(prefixes[1], "gram").filter(near).select("l", "r").distinct()
    return pairs.withColumn("score", similarity(F.col("l"), F.col("r"))).filter(F.col("score") >= threshold).select(F.col("l").alias(left_key), F.col("r").alias(right_key), "score")


def exact_variants(names: DataFrame, synonyms: DataFrame, name: str = "name", variants: str = "variants") -> DataFrame:
    """(name, id, key): the first of a name's variants that is a synonym key; of several ids of a key the least."""
    keys = synonyms.groupBy("key").agg(F.min("id").alias("id"))
    rows = names.select(name, F.posexplode(variants).alias("pos", "key")).join(keys, "key")
    return best_per_key(rows, name, [F.col("pos")]).select(name, "id", "key")


def cascade_match(names: DataFrame, synonyms: DataFrame, overrides: DataFrame, name: str = "name", threshold: float = 85.0, strict: bool = False, weighted: bool = False) -> DataFrame:
    """One row a distinct name: id, matched_key, match_method, fuzzy_score.

    Tried in turn, each on what is left: an override of the normalised name, by id ("override_cid")
    or by key ("override_key"); an override of a variant ("override_variant"); a variant that is a
    synonym key ("exact"); the most similar key of the first variant ("fuzzy", ties to the smaller
    key); else "none". overrides: (name, id, key); either of the last two may be null. weighted: likeness
    is that of best_weighted(), which knows partial alignments and sets of words, in place of fuzzy_join()'s.
    """
    first = checkpointed(synonyms.groupBy("key").agg(F.min("id").alias("id")))
    n = names.select(name).filter(F.col(name).isNotNull()).distinct()
    n = n.withColumn("norm", T.normalize_key(F.col(name))).withColumn("variants", T.candidate_keys(F.col(name), strict))
    n = checkpointed(n)
    o = overrides.select(T.normalize_key(F.col("name")).alias("o_name"), F.col("id").alias("o_id"), F.col("key").alias("o_key"))
    o = o.join(first.select(F.col("key").alias("o_key"), F.col("id").alias("k_id")), "o_key", "left").groupBy("o_name").agg(F.min(F.struct("o_id", "k_id", "o_key")).alias("o")).select("o_name", "o.*")
    o = checkpointed(o.withColumn("found", F.coalesce("o_id", "k_id")).filter(F.col("found").isNotNull()))

    def shape(df, method, score):
        return df.select(name, F.col("id"), F.col("matched_key"), method.alias("match_method"), score.cast("double").alias("fuzzy_score"))

    null = F.lit(None)
    by_name = lookup_join(n, o, n["norm"] == o["o_name"], "inner")
    by_id = F.when(F.col("o_id").isNotNull(), "override_cid").otherwise("override_key")
    by_name = shape(by_name.select(name, F.col("found").alias("id"), F.col("o_key").alias("matched_key"), by_id.alias("m")), F.col("m"), null)
    rest = n.join(by_name, name, "left_anti")
    tried = lookup_join(rest.select(name, F.posexplode("variants").alias("pos", "v")), o, F.col("v") == F.col("o_name"), "inner")
    by_variant = shape(best_per_key(tried, name, [F.col("pos")]).select(name, F.col("found").alias("id"), F.coalesce("o_key", "v").alias("matched_key")), F.lit("override_variant"), null)
    rest = rest.join(by_variant, name, "left_anti")
    exact = shape(exact_variants(rest, synonyms, name).withColumnRenamed("key", "matched_key"), F.lit("exact"), F.lit(100.0))
    rest = checkpointed(rest.join(exact, name, "left_anti").withColumn("v0", F.get("variants", F.lit(0))))
    if weighted:
        best = best_weighted(rest.select("v0"), first, "v0", "key", threshold)
    else:
        best = best_per_key(fuzzy_join(rest.select("v0"), first, "v0", "key", threshold), "v0", [F.desc("score"), F.col("key")])
    best = best.join(first, "key")
    fuzzy = shape(rest.join(best, "v0").select(name, "id", F.col("key").alias("matched_key"), "score"), F.lit("fuzzy"), F.col("score"))
    none = shape(rest.join(fuzzy, name, "left_anti").select(name, null.cast("string").alias("id"), null.cast("string").alias("matched_key")), F.lit("none"), null)
    return by_name.unionByName(by_variant).unionByName(exact).unionByName(fuzzy).unionByName(none)
