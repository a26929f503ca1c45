"""Compound to gene to disease from articles, for all compounds of a lexicon at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph.checkpoint import checkpointed
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import mining, paths, phrases, relational, stats
from evigraph.sources import tables as IO

#: Genes that need no gene word in their sentence, and the one that beverage words rule out.
NO_CONTEXT = ("CYP1A2", "ADORA2A")
BEVERAGE_GENE = "SSB"
#: The compound for which a keyword that names coffee is worth an alert.
ALERTED = "caffeine"


def article_sentences(papers: DataFrame) -> DataFrame:
    """pmid, idx, sentence (lower case), cue flags and polarity."""
    text = F.concat_ws(" ", "title", "abstract")
    rows = mining.split_sentences(papers.filter("pmid is not null"), "pmid", text).withColumn("sentence", F.lower("sentence"))
    names = ("up", "down", "bind", "modulate", "direct", "genetic", "gene_context", "beverage", "intervention", "enzyme", "coffee")
    return mining.flag_cues(rows, {n: L.cue(n) for n in names}).withColumn("polarity", T.polarity(F.col("sentence")))


def compound_sentences(sentences: DataFrame, compounds: DataFrame, require_intervention: bool = True, longest: int = 4) -> DataFrame:
    """(compound, pmid, idx): sentences that name a compound, not an enzyme of like name, and an intervention if asked for.

    longest: words that a synonym has at most.
    """
    rows = sentences.filter(~F.col("enzyme"))
    rows = rows.filter("intervention") if require_intervention else rows
    proxy = F.col("coffee") & ~F.col("sentence").rlike(r"\bcaffein")
    hits = phrases.phrase_hits(rows.withColumn("proxy", proxy), ["pmid", "idx", "proxy"], F.col("sentence"), compounds, "synonym", longest)
    return hits.filter((F.col("compound") != "caffeine") | ~F.col("proxy")).select("compound", "pmid", "idx").distinct()


def gene_mentions(papers: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(pmid, gene): genes of an article by lexicon, or capital tokens where there is none."""
    rows = papers.select("pmid", F.concat_ws(" ", "title", "abstract").alias("text"))
    if aliases is None:
        return rows.select("pmid", F.explode(T.upper_tokens(F.col("text"))).alias("gene"))
    return mining.dictionary_hits(rows, T.gene_tokens(F.col("text")), aliases, ["pmid"]).select("pmid", F.col("symbol").alias("gene")).distinct()


def interactions(papers: DataFrame, compounds: DataFrame, aliases: DataFrame | None = None, window: int = 0, require_intervention: bool = True, sentences: DataFrame | None = None) -> DataFrame:
    """compound, pmid, gene, gene_display, kind, score, direct_hits, strength, confidence, context, species: votes of sentences about both. sentences: article_sentences(), stored, if at hand."""
    sentences = checkpointed(article_sentences(papers)) if sentences is None else sentences
    in_compound = checkpointed(compound_sentences(sentences, compounds, require_intervention))
    pairs = in_compound.select("compound", "pmid").distinct()
    # an article's few genes, in its own row; its sentences are told apart there, so no word of them is shuffled
    genes = gene_mentions(papers, aliases).join(pairs, "pmid", "left_semi").groupBy("pmid").agg(F.collect_set("gene").alias("genes"))
    s = sentences.select("pmid", "idx", "up", "down", "bind", "modulate", "direct", "genetic", "gene_context", "beverage", "sentence").join(genes, "pmid")
    for flag in ("direct", "beverage"):
        s = mining.any_in_band(s, "pmid", flag, window, f"{flag}_near")
    told = F.filter("genes", lambda g: (F.col("gene_context") | g.isin(*NO_CONTEXT)) & F.contains("sentence", F.lower(g)))
    s = s.withColumn("genes", told).filter(F.size("genes") > 0)
    flags = ("up", "down", "bind", "modulate", "genetic", "direct_near", "beverage_near")
    s = checkpointed(s.select("pmid", "idx", *flags, F.explode(T.names_in(F.col("sentence"), F.col("genes"), F.lower, longest=0)).alias("gene")))
    # the band is found on ids alone
    places = s.select("pmid", "idx").distinct().join(pairs, "pmid").select("compound", "pmid", "idx", F.lit(False).alias("is_compound"))
    places = places.unionByName(in_compound.withColumn("is_compound", F.lit(True)))
    places = mining.band(places, ["compound", "pmid"], "is_compound", window).filter(~F.col("is_compound") & F.col("near").isNotNull())
    keys = ["compound", "pmid", "gene"]
    hits = checkpointed(places.drop("is_compound").join(s, ["pmid", "idx"]))
    ruled_out = hits.filter((F.col("gene") == BEVERAGE_GENE) & F.col("beverage_near")).select(*keys).distinct()
    hits = hits.join(ruled_out, keys, "left_anti")
    cues = {"upregulation": "up", "downregulation": "down", "binding": "bind", "modulation": "modulate"}
    votes = mining.vote(hits, keys, cues=cues, genetic="genetic")
    # texts join only what is told of each key
    first = relational.top_k(hits.select(*keys, "idx", "near"), keys, [F.col("idx")], 3).select(*keys, "idx", "near", F.explode(F.array_distinct(F.array("idx", "near"))).alias("place"))
    said = first.join(sentences.select("pmid", F.col("idx").alias("place"), "sentence"), ["pmid", "place"])
    own = F.col("place") == F.col("idx")
    said = said.groupBy(*keys, "idx", "near").agg(F.max(F.when(own, F.col("sentence"))).alias("sentence"), F.max(F.when(~own, F.col("sentence"))).alias("near_sentence"))
    context = mining.contexts(said, keys, "sentence", "near_sentence")
    rows = votes.join(context, keys, "left").join(papers.select("pmid", F.col("primary_species").alias("species"), "species_tags"), "pmid")
    return rows.withColumn("gene_display", T.species_label(F.col("gene"), F.col("species"), F.lit(aliases is not None)))


def disease_mentions(papers: DataFrame) -> DataFrame:
    """(pmid, name, ui, source, normalized): diseases of each article from headings, then terms, then suffixes."""
    text = F.concat_ws(" ", "title", "abstract")
    spark = papers.sparkSession
    head = papers.select("pmid", F.explode("mesh_detail").alias("m")).select("pmid", T.strip(F.col("m.name")).alias("name"), F.col("m.ui").alias("ui"))
    low = F.lower("name")
    head = head.filter((F.col("name") != "") & (low.rlike(L.either(L.HEADING_TERMS)) | low.rlike("(?U)" + L.DISEASE_SUFFIX))).withColumn("source", F.lit("mesh"))
    nothing = F.lit(None).cast("string").alias("ui")
    terms = papers.select("pmid", F.explode(T.word_parts(text, L.DISEASE_TERMS)).alias("name"), nothing, F.lit("text").alias("source"))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z\-]{3,}\b"), F.lit(0)))
    named = F.filter(tokens, lambda t: F.lower(t).rlike("(?U)" + L.DISEASE_SUFFIX))
    suffix = papers.select("pmid", F.explode(named).alias("name"), nothing, F.lit("suffix").alias("source"))
    stop = spark.createDataFrame([(x,) for x in L.NOT_DISEASES], "stop string")
    norm = [d.withColumn("normalized", T.token(F.col("name"))) for d in (head, terms, suffix)]
    rows = relational.priority_union(*norm, keys=["pmid", "normalized"], order=[F.col("name")])
    return rows.join(F.broadcast(stop.select(T.token(F.col("stop")).alias("normalized"))), "normalized", "left_anti")


def gene_disease_links(papers: DataFrame, found: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """gene, disease, evidence_count, docs, votes, direction, relationship, species: genes of interactions and diseases in one sentence.

    Only articles with an interaction are looked at, and only genes and diseases of the article leave
    a sentence. sentences: article_sentences(), stored, if at hand.
    """
    s = checkpointed(article_sentences(papers)) if sentences is None else sentences
    found = found.select("pmid", "gene").distinct()
    named = found.select("pmid", F.lower("gene").alias("phrase"), "gene", F.lit(None).cast("string").alias("disease"))
    named = named.unionByName(disease_mentions(papers.join(found, "pmid", "left_semi")).select("pmid", T.normalize_key(F.col("name")).alias("phrase"), F.lit(None).cast("string").alias("gene"), F.col("normalized").alias("disease")))
    # an article's few names, in its own row
    named = named.groupBy("pmid").agg(F.collect_list(F.struct("phrase", "gene", "disease")).alias("names"))
    hits = s.select("pmid", "idx", "polarity", "sentence").join(named, "pmid")
    # words are told apart only in sentences that hold the first word of a name
    hits = hits.withColumn("names", F.filter("names", lambda x: F.contains("sentence", F.split(x["phrase"], " ")[0]))).filter(F.size("names") > 0)
    hits = checkpointed(hits.select("pmid", "idx", "polarity", F.inline(T.names_in(F.col("sentence"), F.col("names"), lambda x: x["phrase"]))))
    genes = hits.filter("gene IS NOT NULL").select("pmid", "idx", "gene", "polarity").distinct()
    diseases = hits.filter("disease IS NOT NULL").select("pmid", "idx", "disease").distinct()
    links = mining.co_mentions(genes, diseases, "pmid", "gene", "disease")
    species = genes.join(diseases, ["pmid", "idx"]).select("pmid", "gene", "disease").distinct().join(papers.select("pmid", "primary_species"), "pmid")
    counts = species.groupBy("gene", "disease", "primary_species").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("gene", "disease").agg(F.max_by("primary_species", F.struct("n", "primary_species")).alias("species"))
    return links.join(common, ["gene", "disease"])


def analyze(papers: DataFrame, compounds: DataFrame, aliases: DataFrame | None = None, window: int = 0, min_evidence: int = 1, min_confidence: float = 0.0, human_only: bool = False, sentences: DataFrame | None = None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions, gene-disease links, effects of compounds on diseases).

    sentences, before: article_sentences() and interactions() of all these papers, stored, if at hand.
    """
    if human_only:
        papers = papers.filter(F.array_contains("mesh_terms", "Humans"))
    sentences = checkpointed(article_sentences(papers)) if sentences is None else sentences
    rows = interactions(papers, compounds, aliases, window, sentences=sentences) if before is None else before
    found = checkpointed(rows.filter(F.col("confidence") >= min_confidence))
    links = checkpointed(gene_disease_links(papers, found, sentences))
    counts = found.groupBy("compound", "gene", "species").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("compound", "gene").agg(F.max_by("species", F.struct("n", "species")).alias("gene_species"))
    # a link without a species takes that of the compound's articles about the gene
    species = F.when(F.col("link_species") == "unspecified", F.col("gene_species")).otherwise(F.col("link_species"))
    relations = links.withColumnRenamed("species", "link_species").join(own, "gene").withColumn("species", species).drop("gene_species", "link_species")
    effects = mining.compose(found, relations, ["compound", "gene"], ["compound", "gene"], "disease", min_evidence, "species")
    return found, links, effects


def search_classes(papers: DataFrame, base: str, classes: dict[str, tuple[str, ...]], max_papers: int, since: str | None = None, until: str | None = None) -> DataFrame:
    """(pmid, list_no, pos): articles that name the base term and a term of a class, the newest of each class up to its share."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    rows = papers.filter(F.contains(text, F.lit(base.lower())))
    rows = rows.filter(F.col("pub_date") >= since) if since else rows
    rows = rows.filter(F.col("pub_date") <= until) if until else rows
    share = max(50, max_papers // max(1, len(classes)))
    lists = []
    for terms in classes.values():
        best = rows.filter(T.contains_any([text], terms)).orderBy(F.desc("pub_date"), "pmid").limit(share).select("pmid", "pub_date").withColumn("one", F.lit(1))
        lists.append(relational.top_k(best, "one", [F.desc("pub_date"), F.col("pmid")], share, "pos").select("pmid", "pos"))
    return relational.ordered_union(lists, "pmid", "pos").orderBy("list_no", "pos").limit(max_papers)


def counted(rows: DataFrame, value, name: str, top: int | None = None) -> DataFrame:
    """One row: a map of values to their counts, the most frequent `top` of them (ties by value)."""
    n = rows.select(value.alias("k")).filter(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    n = n.orderBy(F.desc("n"), "k").limit(top) if top else n
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def result_stats(found: DataFrame, effects: DataFrame, papers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: totals, strong ones, distinct genes and diseases, mean confidence, dropped ones, and counts by kind, species, publication type and alert.

    before: interactions before the filter by confidence, to count those that it dropped.
    """
    a = found.agg(F.count(F.lit(1)).alias("interactions"), F.count_if(F.col("strength") == "strong").alias("strong"), F.countDistinct("gene").alias("genes"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    b = effects.agg(F.count(F.lit(1)).alias("effects"), F.countDistinct("disease").alias("diseases"))
    used = papers.join(found.select("pmid").distinct(), "pmid", "left_semi")
    alerts = papers.join(found.filter(F.col("compound") == ALERTED).select("pmid").distinct(), "pmid", "left_semi").filter(coffee_keyword(F.col("keywords")))
    out = _one_row(
        a, b, counted(found, F.col("kind"), "by_kind"), counted(found, F.col("species"), "by_species", 6),
        counted(used, F.explode("publication_types"), "by_publication_type", 6), counted(alerts, F.lit("coffee_keyword"), "alerts"),
        (found if before is None else before).agg(F.count(F.lit(1)).alias("before_filter")),
    )
    return out.withColumn("filtered_out", F.col("before_filter") - F.col("interactions"))


def top_findings(effects: DataFrame, n: int = 12) -> DataFrame:
    """The surest effects, ties by name."""
    return effects.orderBy(F.desc("path_confidence"), "compound", "gene", "disease").limit(n)


def compound_graph(found: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): compounds to genes, genes to diseases."""
    return paths.weighted_graph(found, links, "compound", "gene", "disease", "evidence_count")


def _one_row(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = stats.with_row(out, t)
    return out


def coffee_keyword(keywords: Column) -> Column:
    return F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(k), F.lit("coffee"))), F.lit(False))


def study_context(papers: DataFrame) -> DataFrame:
    """pmid, context (publication types, amounts and durations of an article, labelled, those that it has), coffee (whether a keyword names it)."""
    text = F.concat_ws(" ", "title", "abstract")
    def part(label, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}:"), F.array_join(items, ",")))

    said = F.concat_ws(" | ", part("pub", F.slice(F.array_sort("publication_types"), 1, 3)), part("dose", T.dose_mentions(text)), part("time", T.time_mentions(text)))
    return papers.select("pmid", said.alias("context"), coffee_keyword(F.col("keywords")).alias("coffee"))


def with_alert(compound: Column) -> Column:
    """The context of study_context(), and an alert where an article about caffeine is filed under coffee."""
    alert = F.when((compound == ALERTED) & F.col("coffee"), "alerts:coffee_keyword")
    return F.concat_ws(" | ", F.nullif(F.col("study"), F.lit("")), alert)


def flat_rows(found: DataFrame, effects: DataFrame, papers: DataFrame) -> DataFrame:
    """A row for each compound, gene and disease with its rule, confidence, contexts and snippets of up to 160 characters."""
    snippets = relational.top_k(found, ["compound", "gene"], [F.desc("confidence"), F.col("pmid")], 3, "r")
    snippets = snippets.join(study_context(papers).withColumnRenamed("context", "study"), "pmid", "left")
    snippet = F.concat(F.col("pmid"), F.lit(": "), T.clip_label(F.coalesce("context", F.lit("")), 160, dots=True))
    # at most three rows each
    per = snippets.groupBy("compound", "gene").agg(F.array_join(F.array_sort(F.collect_list(snippet)), " || ").alias("snippets"), F.array_join(F.array_sort(F.collect_set(with_alert(F.col("compound")))), " ; ").alias("study_context"))
    return effects.join(per, ["compound", "gene"], "left").join(kind_tags(found), ["compound", "gene"], "left")


def kind_tags(found: DataFrame) -> DataFrame:
    """(compound, gene, tags): counted kinds of interaction, of which there are few."""
    kinds = found.groupBy("compound", "gene", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("compound", "gene").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ", ").alias("tags"))


def nested_context(papers: DataFrame) -> DataFrame:
    """(pmid, study): what an article says about its study, as one struct; at most 15 headings and 12 keywords."""
    text = F.concat_ws(" ", "title", "abstract")
    study = F.struct("publication_types", F.slice("mesh_terms", 1, 15).alias("mesh_terms"), F.slice("keywords", 1, 12).alias("keywords"), F.col("species_tags").alias("species"), T.dose_mentions(text).alias("doses"), T.time_mentions(text).alias("times"))
    return papers.select("pmid", study.alias("study"))


# Columns of the evidence file.
EVIDENCE_COLUMNS = ("Compound", "Gene (species)", "Drug->Gene", "Gene->Disease", "Drug->Disease (predicted)", "Rule", "Confidence", "Species", "Study context", "Evidence snippets", "Evidence tags")


def evidence_rows(found: DataFrame, effects: DataFrame, papers: DataFrame) -> DataFrame:
    """EVIDENCE_COLUMNS of each effect; snippets are those of the articles that link gene and disease, three at most, ids alone where the compound has none."""
    pair = ["compound", "gene"]
    surest = found.groupBy(*pair).agg(F.max_by("strength", S.choose(F.col("strength"), {"strong": 2, "moderate": 1}, 0)).alias("main_strength"), F.max("gene_display").alias("label"))
    cited = effects.select(*pair, "disease", F.posexplode("docs").alias("place", "pmid"))
    said = cited.join(found.select(*pair, F.col("pmid").cast("string").alias("pmid"), "context"), [*pair, "pmid"], "left")
    said = said.join(study_context(papers).select(F.col("pmid").cast("string").alias("pmid"), F.col("context").alias("study"), "coffee"), "pmid", "left")
    snippet = F.concat_ws(": ", "pmid", F.nullif(T.clip_label(F.col("context"), 160, dots=True), F.lit("")))
    per = said.groupBy(*pair, "disease").agg(F.array_sort(F.collect_list(F.struct("place", snippet.alias("snippet")))).alias("snippets"), F.array_sort(F.collect_set(F.nullif(with_alert(F.col("compound")), F.lit("")))).alias("studies"))
    rows = effects.join(surest, pair).join(per, [*pair, "disease"], "left").join(kind_tags(found), pair, "left")
    values = [
        F.col("compound"), F.col("label"), F.format_string("%s (%s)", "main", "main_strength"), F.format_string("%s (%s)", "relationship", "direction"), F.col("effect"), F.col("rule"), F.col("path_confidence"), F.col("species"),
        F.array_join("studies", " ; "), F.array_join(F.transform("snippets", lambda x: x["snippet"]), " || "), F.col("tags"),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, EVIDENCE_COLUMNS)])


def ranked(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interactions and links in the order of reports: surest first; most evidence first, of like evidence those with a direction."""
    decided = F.when(F.col("direction") == "neutral", 1).otherwise(2)
    return found.orderBy(F.desc("confidence"), "compound", "pmid", "gene"), links.orderBy(F.desc("evidence_count"), F.desc(decided), "gene", "disease")


#: Columns by which documents of compounds and their items are written.
DOCUMENT_ORDER = ("compound", "section", "doubt", "gene", "pmid", "disease")


def by_compound(found: DataFrame, effects: DataFrame) -> DataFrame:
    """DOCUMENT_ORDER and interaction or effect: a compound's interactions (section 1), then its effects (section 2), the surest first."""
    def part(rows: DataFrame, section: int, sure: str, name: str) -> DataFrame:
        ids = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("gene", "pmid", "disease")]
        return rows.select("compound", F.lit(section).alias("section"), (1 - F.col(sure)).alias("doubt"), *ids, F.struct(*[c for c in rows.columns if c != "compound"]).alias(name))

    return part(found, 1, "confidence", "interaction").unionByName(part(effects, 2, "path_confidence", "effect"), allowMissingColumns=True)


def write_results(found: DataFrame, links: DataFrame, effects: DataFrame, papers: DataFrame, out: str) -> None:
    """The complete result: interactions with their studies, links and effects as JSON, an object a line, a JSON document of each compound, and the evidence as CSV.

    All in the order of reports.
    """
    # stored, since each sort reads its rows twice, and studies are read out of whole texts
    with_study = checkpointed(found.join(nested_context(papers), "pmid", "left"))
    evidence = checkpointed(evidence_rows(found, effects, papers))
    first, second = ranked(with_study, links)
    first.write.mode("overwrite").json(f"{out}/interactions")
    second.write.mode("overwrite").json(f"{out}/links")
    effects.orderBy(F.desc("path_confidence"), "compound", "gene", "disease").write.mode("overwrite").json(f"{out}/effects")
    IO.write_documents(by_compound(with_study, effects), f"{out}/documents", *DOCUMENT_ORDER)
    IO.write_sorted_csv(evidence, f"{out}/evidence_csv", F.desc("Confidence"), *[F.col(f"`{c}`") for c in EVIDENCE_COLUMNS[:4]])
