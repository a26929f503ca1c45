"""Text mining: sentences, dictionary hits, cues in a band of sentences, votes, co-mentions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.columns import own_names
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators.relational import is_small, top_k

#: Kinds of vote in the order in which they break ties, and the weight of a cue of each.
VOTES = {"upregulation": 1.2, "downregulation": 1.2, "binding": 0.8, "modulation": 0.6}


def split_sentences(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, idx, sentence)"""
    return docs.select(id_col, F.posexplode(T.sentences(text)).alias("idx", "sentence"))


def flag_cues(sentences: DataFrame, patterns: Mapping[str, str], text: str = "sentence") -> DataFrame:
    """A boolean column for each pattern, each found once a sentence."""
    return sentences.withColumns({n: F.col(text).rlike(p) for n, p in patterns.items()})


def dictionary_hits(rows: DataFrame, tokens: Column, lexicon: DataFrame, keys: Sequence[str], form: str = "form", forms=None, most: int = 2) -> DataFrame:
    """Rows of keys for each distinct token that the lexicon has, as it is or without hyphens, the first form that hits.

    forms: a token to its array of forms, of which the first `most` are looked up; the lexicon has
    each form once. The lookups are joins of their own, so that rows stay where they are.
    """
    forms = forms or (lambda t: F.array_distinct(F.array(F.upper(t), F.replace(F.upper(t), F.lit("-"), F.lit("")))))
    found, form_names = [c for c in lexicon.columns if c != form], [f"{form}_{i}" for i in range(most)]
    t = rows.select(*keys, F.explode(F.array_distinct(tokens)).alias("token"))
    t = t.select("*", *[F.get(forms(F.col("token")), F.lit(i)).alias(n) for i, n in enumerate(form_names)])
    narrow = is_small(lexicon)
    for i, n in enumerate(form_names):
        entry = lexicon.select(F.col(form).alias(n), F.struct(*found).alias(f"hit_{i}"))
        t = t.join(F.broadcast(entry) if narrow else entry, n, "left")
    hit = F.coalesce(*[F.col(f"hit_{i}") for i in range(most)])
    return t.select(*keys, "token", hit.alias("hit")).filter(F.col("hit").isNotNull()).select(*keys, "token", "hit.*")


def alias_index(genes: DataFrame, symbol: str, aliases: Sequence[str], order: str) -> DataFrame:
    """(form, symbol): forms of symbols and piped aliases; the row that comes first in `order` owns a form."""
    names = F.concat(F.array(F.col(symbol)), *[F.filter(F.transform(T.list_tokens(F.col(a)), T.strip), lambda x: x != "") for a in aliases])
    forms = genes.filter(T.strip(F.col(symbol)) != "").select(F.upper(T.strip(F.col(symbol))).alias("symbol"), order, F.explode(F.flatten(F.transform(names, T.alias_forms))).alias("form"))
    return forms.groupBy("form").agg(F.min_by("symbol", F.struct(order, "symbol")).alias("symbol"))


def band(sentences: DataFrame, doc: str | Sequence[str], flag: str, width: int, name: str = "near", prefer_same: bool = False) -> DataFrame:
    """The least idx of a flagged sentence within `width` sentences, null for none; the sentence's own first if prefer_same."""
    w = Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy("idx").rangeBetween(-width, width)
    first = F.min(F.when(F.col(flag), F.col("idx"))).over(w)
    return sentences.withColumn(name, F.when(F.col(flag), F.col("idx")).otherwise(first) if prefer_same else first)


def any_in_band(sentences: DataFrame, doc: str, flag: str, width: int, name: str) -> DataFrame:
    return sentences.withColumn(name, F.max(flag).over(Window.partitionBy(doc).orderBy("idx").rangeBetween(-width, width)))


def banded_sentences(docs: DataFrame, id_col: str, text: Column, near: str, direct: str, width: int) -> DataFrame:
    """(id, idx, sentence, near, direct_near): what band() and any_in_band() find for the patterns near and direct.

    All sentences of a document are in one row to begin with, so their neighbours are found there,
    and nothing is shuffled.
    """
    def rows(parts: Column) -> Column:
        def flagged(pattern: str) -> Column:
            return F.transform(parts, lambda x: x.rlike(pattern))

        def one(nears: Column, directs: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                first = F.greatest(i - width, F.lit(0))
                n = i + width + 1 - first
                at = F.array_position(F.slice(nears, first + 1, n), True)
                hint = F.array_contains(F.slice(directs, first + 1, n), True)
                return F.struct(i.alias("idx"), x.alias("sentence"), F.when(at > 0, first + at - 1).cast("int").alias("near"), hint.alias("direct_near"))

            return F.transform(parts, place)

        return T.let(flagged(near), lambda nears: T.let(flagged(direct), lambda directs: one(nears, directs)))

    return docs.select(id_col, F.inline(T.let(T.sentences(text), rows)))


def vote(hits: DataFrame, keys: Sequence[str], *, cues: Mapping[str, str], genetic: str | None = None, near: str = "near", direct: str = "direct_near") -> DataFrame:
    """One row a key: kind, score, direct_hits, strength, confidence.

    hits: a row for each sentence of a key, with idx, near (place of the other party's sentence),
    cue flags, and direct (a direct hint is near). A sentence weighs 1.5 with the other party in it,
    else 0.5, and 1.3 times that with a direct hint. cues: kind to flag column. Highest sum wins;
    ties go to the kind that got its first vote first. Keys without a vote have no row.
    """
    same = F.col(near) == F.col("idx")
    base = F.when(same, 1.5).otherwise(0.5) * F.when(F.col(direct), 1.3).otherwise(1.0)
    kinds = [(kind, flag, F.lit(VOTES[kind]) * base) for kind, flag in cues.items()]
    if genetic:
        kinds.append(("genetic_association", genetic, 0.9 * F.when(same, 0.9).otherwise(0.6)))
    sums = [F.count_if(direct).alias("direct_hits")]
    for i, (_, flag, weight) in enumerate(kinds):
        sums += [F.sum(F.when(F.col(flag), weight)).alias(f"score_{i}"), F.min(F.when(F.col(flag), F.col("idx"))).alias(f"first_{i}")]
    rows = hits.filter(F.col(near).isNotNull()).groupBy(*keys).agg(*sums)
    # the least of these has the highest sum, then the first vote, then the first kind
    ranked = [F.when(F.col(f"first_{i}").isNotNull(), F.struct((-F.round(f"score_{i}", 9)).alias("minus"), F.col(f"first_{i}").alias("first"), F.lit(i).alias("no"), F.lit(kind).alias("kind"))) for i, (kind, _, _) in enumerate(kinds)]
    rows = rows.withColumn("best", F.array_min(F.array_compact(F.array(*ranked)))).filter(F.col("best").isNotNull())
    rows = rows.select(*keys, F.col("best.kind").alias("kind"), (-F.col("best.minus")).alias("score"), "direct_hits")
    strength = S.vote_strength(F.col("kind"), F.col("score"), F.col("direct_hits"))
    return rows.withColumn("strength", strength).withColumn("confidence", S.vote_confidence(F.col("strength"), F.col("score")))


def contexts(hits: DataFrame, keys: Sequence[str], text: str = "sentence", near_text: str | None = None, k: int = 3) -> DataFrame:
    """(keys, context): the first k sentences of a key, with the near sentence after " || " where it is another; joined by " | "."""
    c = F.col(text)
    if near_text:
        c = F.when(F.col("near") != F.col("idx"), F.concat_ws(" || ", text, near_text)).otherwise(c)
    said, rank = own_names(hits.columns, "said", "rank")
    rows = top_k(hits.withColumn(said, c), keys, [F.col("idx")], k, rank)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", said))), lambda x: x[said]), " | ").alias("context"))


def co_mentions(a: DataFrame, b: DataFrame, doc: str, left: str, right: str, polarity: str = "polarity") -> DataFrame:
    """links() of what is named in one sentence. a and b: (doc, idx, left or right); polarity is a column of a."""
    return links(a.join(b, [doc, "idx"]), doc, left, right, polarity)


def links(pairs: DataFrame, doc: str, left: str, right: str, polarity: str = "polarity") -> DataFrame:
    """One row a pair: evidence_count (documents), docs (first 3), votes by polarity, direction, relationship.

    pairs: a row for each sentence that names both. Sentences are summed by document first, and of a
    pair's documents each task keeps three, so that a pair in a third of all documents gathers nowhere.
    The sums by document are stored, so that pairs are worked out once.
    """
    votes = [F.count_if(F.col(polarity) == x).alias(f"n_{x}") for x in ("positive", "negative")]
    by_doc = checkpointed(pairs.groupBy(left, right, F.col(doc).alias("doc")).agg(*votes))
    g = by_doc.groupBy(left, right).agg(F.count("doc").alias("evidence_count"), F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative"))
    named = by_doc.select(left, right, F.col("doc").cast("string").alias("doc")).filter(F.col("doc").isNotNull())
    docs = top_k(named, [left, right], [F.col("doc")], 3).groupBy(left, right).agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    direction = F.when(F.col("n_positive") > F.col("n_negative"), "positive").when(F.col("n_negative") > F.col("n_positive"), "negative").otherwise("neutral")
    relation = F.when(F.col("direction") == "positive", "risk_factor").when(F.col("direction") == "negative", "protective").otherwise("associated")
    g = g.join(docs, [left, right], "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    g = g.select(left, right, "evidence_count", "docs", "n_positive", "n_negative")
    return g.withColumn("direction", direction).withColumn("relationship", relation)


def main_interaction(rows: DataFrame, key, kind: str = "kind", strength: str = "strength", confidence: str = "confidence") -> DataFrame:
    """One row a key: main kind (strong 3, moderate 2, weak 1 summed; ties by kind), both directions seen, best confidence."""
    by = [key] if isinstance(key, str) else list(key)
    weight = S.choose(F.col(strength), {"strong": 3, "moderate": 2}, 1)
    total, best = own_names([*by, kind], "total", "best")
    per_kind = rows.groupBy(*by, kind).agg(F.sum(weight).alias(total), F.max(confidence).alias(best))
    return per_kind.groupBy(*by).agg(
        F.max_by(kind, F.struct(F.col(total), kind)).alias("main"),
        (F.bool_or(F.col(kind) == "upregulation") & F.bool_or(F.col(kind) == "downregulation")).alias("conflicting"),
        F.max(best).alias("confidence"),
    )


def compose(interactions: DataFrame, relations: DataFrame, left: Sequence[str], gene: str, disease: str, min_evidence: int = 1, species: str | None = None) -> DataFrame:
    """Effects of compounds on diseases through genes: main, relationship, effect, confidence, rule. left: columns of a compound, gene among them."""
    joined = main_interaction(interactions, left).join(relations.filter(F.col("evidence_count") >= min_evidence), gene)
    sp = F.col(species) if species else F.lit("unspecified")
    effect = S.compose_effect(F.col("main"), F.col("relationship"), F.col("direction"), sp, F.col("conflicting"))
    out = joined.withColumn("effect", effect)
    label = F.when(sp != "unspecified", F.concat(F.lit(" ["), sp, F.lit("]"))).otherwise("")
    rule = F.concat(F.lit("compose("), "main", F.lit(","), "relationship", F.lit(")"), label, F.lit(" -> "), "effect")
    return out.withColumn("rule", rule).withColumn("path_confidence", S.path_confidence(F.col("confidence"), F.col("evidence_count"), F.col("effect"))).drop("confidence")
