"""The literature plan over all documents, as articles: their frequent words stand for compounds, genes, diseases and cues.

The SQL beside each query works everything out from the same words: mentions, bands of sentences, votes,
strengths, links, effects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph.checkpoint import checkpoint_folder, checkpointed
from evigraph.functions import text as T
from evigraph.plans import literature
from evigraph.sources import tables as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


#: What frequent words of the invented languages stand for.
STANDS_FOR = {
    "the": "TNF", "of": "caffeine", "and": "diet", "to": "increased", "in": "IL6", "a": "gene", "la": "lecithin", "de": "coffee", "der": "intake", "en": "inhibits", "is": "reduced", "that": "colitis", "on": "hepatitis",
    "que": "SSB", "for": "expression", "it": "directly", "le": "dose", "was": "polymorphism", "as": "ADORA2A", "die": "protects", "with": "binds", "are": "modulates", "this": "drinks", "from": "arthritis", "by": "TNFA",
    "un": "asthma", "les": "promotes", "be": "progression", "und": "5 mg/kg", "et": "3 weeks", "or": "unchanged",
}
#: Forms of genes; one is an alias, which no sentence tells of by itself.
ALIASES = {"TNF": "TNF", "TNFA": "TNF", "IL6": "IL6", "ADORA2A": "ADORA2A", "SSB": "SSB"}
COMPOUNDS = ("caffeine", "coffee", "lecithin")
HEADINGS = {"en": ["Humans", "Diet", *[f"H{i}" for i in range(20)]], "de": ["Mice", "Humans"], "fr": ["Mice"], "es": []}
MIN_CONFIDENCE = 0.2


def papers(spark: SparkSession, sf: str) -> DataFrame:
    d = IO.spread(spark.read.parquet(f"{sf}/documents.parquet"))
    known = F.create_map(*[F.lit(x) for kv in STANDS_FOR.items() for x in kv])
    words = F.transform(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", ""), " "), lambda w: F.when(w.isin(*STANDS_FOR), known[w]).otherwise(w))
    headings = F.array().cast("array<string>")
    for lang, names in HEADINGS.items():
        headings = F.when(F.col("lang") == lang, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(headings)
    one = F.array(F.struct(F.lit("Colitis").alias("name"), F.lit("D1").alias("ui"), F.lit(False).alias("is_major")))
    rows = d.select(
        F.col("doc_id").cast("string").alias("pmid"), F.concat(F.lit("Report "), F.coalesce("source", F.lit("")), F.lit(".")).alias("title"), F.array_join(words, " ").alias("abstract"), headings.alias("mesh_terms"),
        F.when(F.col("source").endswith("1"), one).otherwise(F.slice(one, 1, 0)).alias("mesh_detail"), F.array(F.lit("Review"), F.concat(F.lit("Trial "), F.coalesce("lang", F.lit("")))).alias("publication_types"),
        F.array(F.concat(F.lit("Coffee "), "source"), *[F.lit(f"k{i}") for i in range(14)]).alias("keywords"),
    )
    tags = T.species_tags(F.col("mesh_terms"))
    # read several times
    return checkpointed(rows.withColumn("keywords", F.when(F.col("title").rlike(r"[02468]\.$"), F.col("keywords")).otherwise(F.slice("keywords", 2, 14))).withColumn("primary_species", T.primary_species(tags)).withColumn("species_tags", tags))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "form string, symbol string")


def result(spark: SparkSession, p: DataFrame, **given) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The analysis of papers()."""
    return literature.analyze(p, L.compound_lexicon(spark, COMPOUNDS), aliases(spark), window=1, min_evidence=2, min_confidence=MIN_CONFIDENCE, **given)


def flag(name: str) -> str:
    return f"regexp_matches(low, '(?i){'|'.join(L.CUES[name])}')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def token_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def articles_sql(human_only: bool = False) -> str:
    """Common tables: v interactions, lk links, ef effects."""
    stands = ", ".join(f"'{k}': '{v}'" for k, v in STANDS_FOR.items())
    flags = ", ".join(f"{flag(n)} AS f_{n}" for n in ("up", "down", "bind", "modulate", "direct", "genetic", "gene_context", "beverage", "intervention", "enzyme"))
    kinds = (("upregulation", "up", 1.2), ("downregulation", "down", 1.2), ("binding", "bind", 0.8), ("modulation", "modulate", 0.6))
    votes = " UNION ALL ".join(
        [f"SELECT compound, pmid, gene, {i} AS no, '{k}' AS kind, sum({w}::DOUBLE * base) AS score, min(idx) AS first FROM h WHERE f_{f} GROUP BY ALL" for i, (k, f, w) in enumerate(kinds)]
        + ["SELECT compound, pmid, gene, 4, 'genetic_association', sum(0.9::DOUBLE * CASE WHEN near = idx THEN 0.9 ELSE 0.6 END), min(idx) FROM h WHERE f_genetic GROUP BY ALL"]
    )
    human = "WHERE lang IN ('en', 'de')" if human_only else ""
    positive, negative = flag("positive"), flag("negative")
    return rf"""WITH mp AS (SELECT MAP {{{stands}}} AS m),
          d AS (SELECT doc_id::VARCHAR AS pmid, lang, source, CASE WHEN lang IN ('en', 'de') THEN 'Human' WHEN lang = 'fr' THEN 'Mouse' ELSE 'unspecified' END AS sp,
                concat_ws(' ', 'Report ' || coalesce(source, '') || '.', array_to_string([coalesce(m[w], w) FOR w IN string_split(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ' ')], ' ')) AS t FROM documents, mp {human}),
          s0 AS (SELECT pmid, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '([.?!])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: length(x) > 2) AS ss FROM d),
          s1 AS (SELECT pmid, (i - 1)::INTEGER AS idx, lower(ss[i]) AS low FROM (SELECT pmid, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0)),
          s AS (SELECT pmid, idx, low, {flags}, CASE WHEN {positive} AND NOT {negative} THEN 'positive' WHEN {negative} AND NOT {positive} THEN 'negative' ELSE 'neutral' END AS polarity,
                regexp_extract_all(low, '[\w,:''-]*\w') AS ws FROM s1),
          cs AS (SELECT DISTINCT pmid, idx, compound FROM s, (VALUES ('caffeine'), ('coffee'), ('lecithin')) c(compound) WHERE NOT f_enzyme AND f_intervention AND list_contains(ws, compound)),
          ga AS (SELECT * FROM (VALUES {values(ALIASES.items())}) a(form, gene)),
          g AS (SELECT DISTINCT pmid, gene FROM (SELECT pmid, string_split_regex(t, '\s+') AS ts FROM d), ga WHERE list_contains(ts, form)),
          sc AS (SELECT p.compound, s.*, cs.idx IS NOT NULL AS is_c FROM (SELECT DISTINCT compound, pmid FROM cs) p JOIN s USING (pmid) LEFT JOIN cs ON cs.compound = p.compound AND cs.pmid = p.pmid AND cs.idx = s.idx),
          b AS (SELECT *, min(CASE WHEN is_c THEN idx END) OVER w AS near, bool_or(f_direct) OVER w AS direct_near, bool_or(f_beverage) OVER w AS beverage_near FROM sc WINDOW w AS (PARTITION BY compound, pmid ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
          h0 AS (SELECT b.*, gene, CASE WHEN near = idx THEN 1.5 ELSE 0.5 END::DOUBLE * CASE WHEN direct_near THEN 1.3 ELSE 1.0 END::DOUBLE AS base FROM b JOIN g USING (pmid) WHERE near IS NOT NULL AND list_contains(ws, lower(gene)) AND (f_gene_context OR gene IN ('CYP1A2', 'ADORA2A'))),
          h AS (SELECT * FROM h0 WHERE (compound, pmid, gene) NOT IN (SELECT (compound, pmid, gene) FROM h0 WHERE gene = 'SSB' AND beverage_near)),
          k AS ({votes}),
          dh AS (SELECT compound, pmid, gene, count_if(direct_near)::BIGINT AS direct_hits FROM h GROUP BY ALL),
          k1 AS (SELECT compound, pmid, gene, kind, round(score, 9) AS score, direct_hits FROM k JOIN dh USING (compound, pmid, gene) QUALIFY row_number() OVER (PARTITION BY compound, pmid, gene ORDER BY round(score, 9) DESC, first, no) = 1),
          k2 AS (SELECT *, CASE WHEN direct_hits >= 2 OR (kind IN ('upregulation', 'downregulation') AND score >= 2.8) THEN 'strong' WHEN score >= 1.6 THEN 'moderate' ELSE 'weak' END AS strength FROM k1),
          v0 AS (SELECT *, round(CASE strength WHEN 'strong' THEN least(1.0, score / 4) WHEN 'moderate' THEN least(1.0, score / 3) ELSE 0.4 END::DOUBLE + 1e-10, 3) AS confidence FROM k2),
          v AS (SELECT * FROM v0 WHERE confidence >= {MIN_CONFIDENCE}),
          hx AS (SELECT h.compound, h.pmid, h.gene, h.idx, CASE WHEN near <> h.idx THEN h.low || ' || ' || n.low ELSE h.low END AS said FROM h JOIN s n ON n.pmid = h.pmid AND n.idx = near QUALIFY row_number() OVER (PARTITION BY h.compound, h.pmid, h.gene ORDER BY h.idx) <= 3),
          cx AS (SELECT compound, pmid, gene, string_agg(said, ' | ' ORDER BY idx) AS context FROM hx GROUP BY ALL),
          fg AS (SELECT DISTINCT pmid, gene FROM v),
          st AS (SELECT {token_sql("x")} AS disease FROM (VALUES {values((x,) for x in L.NOT_DISEASES)}) n(x)),
          dw AS (SELECT pmid, unnest(regexp_extract_all(lower(t), '[\w,:''-]*\w')) AS w FROM d),
          dn AS (SELECT DISTINCT pmid, name, {token_sql("name")} AS disease FROM (SELECT pmid, unnest(list_concat([w], string_split_regex(w, '[-'',:]'))) AS name FROM dw) WHERE name IN ({", ".join(repr(x) for x in L.DISEASE_TERMS)})
                 UNION SELECT pmid, lower(name), {token_sql("name")} FROM (SELECT pmid, unnest(regexp_extract_all(t, '\b[A-Za-z][A-Za-z\-]{{3,}}\b')) AS name FROM d) WHERE regexp_matches(lower(name), '\b\w+(?:itis|opathy|oma|omas)\b')
                 UNION SELECT pmid, 'colitis', 'colitis' FROM d WHERE source LIKE '%1'),
          ds AS (SELECT DISTINCT s.pmid, idx, disease FROM s JOIN dn ON dn.pmid = s.pmid AND (list_contains(ws, name) OR list_contains(regexp_extract_all(low, '[a-z0-9]+(?:-[a-z0-9]+)*'), name)) WHERE disease NOT IN (SELECT disease FROM st)),
          gs AS (SELECT s.pmid, idx, gene, polarity FROM s JOIN fg ON fg.pmid = s.pmid AND list_contains(ws, lower(gene))),
          pr AS (SELECT gene, disease, pmid, count_if(polarity = 'positive') AS pos, count_if(polarity = 'negative') AS neg FROM gs JOIN ds USING (pmid, idx) GROUP BY ALL),
          l0 AS (SELECT gene, disease, count(*) AS evidence_count, list_sort(list(pmid))[1:3] AS docs, CASE WHEN sum(pos) > sum(neg) THEN 'positive' WHEN sum(neg) > sum(pos) THEN 'negative' ELSE 'neutral' END AS direction FROM pr GROUP BY ALL),
          ls AS (SELECT gene, disease, sp FROM (SELECT gene, disease, sp, count(*) AS n FROM pr JOIN d USING (pmid) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gene, disease ORDER BY n DESC, sp DESC) = 1),
          lk AS (SELECT l0.*, CASE direction WHEN 'positive' THEN 'risk_factor' WHEN 'negative' THEN 'protective' ELSE 'associated' END AS relationship, sp AS species FROM l0 JOIN ls USING (gene, disease)),
          os AS (SELECT compound, gene, sp AS own FROM (SELECT compound, gene, sp, count(*) AS n FROM v JOIN d USING (pmid) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY compound, gene ORDER BY n DESC, sp DESC) = 1),
          mk AS (SELECT compound, gene, kind, sum(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS total, max(confidence) AS best FROM v GROUP BY ALL),
          mi AS (SELECT compound, gene, max_by(kind, (total, kind)) AS main, bool_or(kind = 'upregulation') AND bool_or(kind = 'downregulation') AS conflicting, max(best) AS confidence FROM mk GROUP BY ALL),
          e0 AS (SELECT mi.*, disease, evidence_count, docs, direction, relationship, CASE WHEN species = 'unspecified' THEN own ELSE species END AS species FROM mi JOIN lk USING (gene) JOIN os USING (compound, gene) WHERE evidence_count >= 2),
          e1 AS (SELECT *, CASE WHEN direction = 'neutral' THEN 'uncertain' WHEN main = 'genetic_association' OR relationship = 'associated' THEN 'association_only' WHEN species NOT IN ('', 'Human', 'unspecified') OR conflicting THEN 'context_specific'
                 WHEN (main = 'upregulation' AND relationship = 'risk_factor') OR (main = 'downregulation' AND relationship = 'protective') THEN 'potentially_harmful'
                 WHEN (main = 'upregulation' AND relationship = 'protective') OR (main = 'downregulation' AND relationship = 'risk_factor') THEN 'potentially_beneficial' ELSE 'uncertain' END AS effect,
                 round((confidence + least(1.0, evidence_count / 5)) / 2 + 1e-10, 3) AS base FROM e0),
          ef AS (SELECT compound, gene, disease, main, relationship, effect, 'compose(' || main || ',' || relationship || ')' || CASE WHEN species <> 'unspecified' THEN ' [' || species || ']' ELSE '' END || ' -> ' || effect AS rule, species, docs, direction,
                 CASE WHEN effect IN ('context_specific', 'association_only') THEN round(base * 0.8 + 1e-10, 3) ELSE base END AS path_confidence FROM e1)"""


@query(articles_sql(human_only=True) + " SELECT compound, pmid, gene, kind, round(score, 6) AS score, direct_hits, strength, confidence, md5(context) AS context FROM v JOIN cx USING (compound, pmid, gene)")
def article_interactions(spark, sf):
    """Interactions in articles about humans that are sure enough, genes by aliases, a sentence's neighbours counted in."""
    found = result(spark, papers(spark, sf), human_only=True)[0]
    return found.select("compound", "pmid", "gene", "kind", F.round("score", 6).alias("score"), "direct_hits", "strength", "confidence", F.md5("context").alias("context"))


@query(articles_sql() + """ SELECT place, gene, disease, evidence_count, array_to_string(docs, ',') AS docs, direction, relationship, species
          FROM (SELECT *, (row_number() OVER (ORDER BY evidence_count DESC, CASE WHEN direction = 'neutral' THEN 1 ELSE 2 END DESC, gene, disease))::INTEGER AS place FROM lk) WHERE place <= 40""")
def article_links(spark, sf):
    """The first forty links of genes and diseases, in the order of reports."""
    links = literature.ranked(*result(spark, papers(spark, sf))[:2])[1].limit(40)
    kept = links.select(F.collect_list(F.struct("gene", "disease", "evidence_count", F.array_join("docs", ",").alias("docs"), "direction", "relationship", "species")).alias("rows"))
    return kept.select(F.posexplode("rows").alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.*")


@query(articles_sql() + " SELECT compound, gene, disease, main, relationship, effect, rule, path_confidence FROM ef")
def article_effects(spark, sf):
    """Effects of compounds on diseases, by rules that mind species and conflicts."""
    return result(spark, papers(spark, sf))[2].select("compound", "gene", "disease", "main", "relationship", "effect", "rule", "path_confidence")


@query(articles_sql() + " SELECT compound, gene, disease, effect, path_confidence FROM ef ORDER BY path_confidence DESC, compound, gene, disease LIMIT 12")
def top_findings(spark, sf):
    """The twelve surest effects."""
    return literature.top_findings(result(spark, papers(spark, sf))[2]).select("compound", "gene", "disease", "effect", "path_confidence")


@query(articles_sql() + f""" SELECT (SELECT count(*) FROM v) AS interactions, (SELECT count(*) FROM v WHERE strength = 'strong') AS strong, (SELECT count(DISTINCT gene) FROM v) AS genes, (SELECT count(*) FROM ef) AS effects, (SELECT count(DISTINCT disease) FROM ef) AS diseases,
          (SELECT count(*) FROM v0) - (SELECT count(*) FROM v) AS filtered_out, (SELECT array_to_string(list_sort(list(kind || ':' || n)), ',') FROM (SELECT kind, count(*) AS n FROM v GROUP BY kind)) AS kinds,
          (SELECT array_to_string(list_sort(list(sp || ':' || n)), ',') FROM (SELECT sp, count(*) AS n FROM v JOIN d USING (pmid) GROUP BY sp)) AS species,
          (SELECT 'coffee_keyword:' || count(DISTINCT pmid) FROM v JOIN d USING (pmid) WHERE compound = 'caffeine' AND regexp_matches(source, '[02468]$')) AS alerts""")
def article_stats(spark, sf):
    """Totals and counters of a result, of what the filter by confidence dropped among them."""
    p = papers(spark, sf)
    sentences = checkpointed(literature.article_sentences(p))
    before = checkpointed(literature.interactions(p, L.compound_lexicon(spark, COMPOUNDS), aliases(spark), 1, sentences=sentences))
    found, _, effects = result(spark, p, sentences=sentences, before=before)
    one = literature.result_stats(found, effects, p, before)
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return one.select("interactions", "strong", "genes", "effects", "diseases", "filtered_out", text("by_kind").alias("kinds"), text("by_species").alias("species"), text("alerts").alias("alerts"))


DOSES_SQL, TIMES_SQL = (f"array_to_string(list_sort(list_distinct([trim(x) FOR x IN regexp_extract_all(t, '(?i){p}')])), ',')" for p in (L.DOSE, L.DURATION))


@query(articles_sql() + rf""" SELECT compound, pmid, gene, kind, confidence, len(CASE lang {" ".join(f"WHEN '{k}' THEN {x[:15]}::VARCHAR[]" for k, x in HEADINGS.items())} ELSE []::VARCHAR[] END)::INTEGER AS headings, 12::INTEGER AS keywords, {DOSES_SQL} AS doses, {TIMES_SQL} AS times FROM v JOIN d USING (pmid)""")
def complete_result(spark, sf):
    """The complete result written as JSON with an object for each interaction and its study, read back; lists in it end after 15 headings and 12 keywords."""
    out = f"{checkpoint_folder(spark)}/articles-{uuid.uuid4().hex}"
    p = papers(spark, sf)
    literature.write_results(*result(spark, p), p, out)
    study = "struct<mesh_terms: array<string>, keywords: array<string>, doses: array<string>, times: array<string>>"
    rows = spark.read.schema(f"compound string, pmid string, gene string, kind string, confidence double, study {study}").json(f"{out}/interactions")
    return rows.select("compound", "pmid", "gene", "kind", "confidence", F.size("study.mesh_terms").alias("headings"), F.size("study.keywords").alias("keywords"), F.array_join("study.doses", ",").alias("doses"), F.array_join("study.times", ",").alias("times"))


@query(articles_sql() + """ SELECT compound, gene, disease, pmid, kind, effect, confidence, (row_number() OVER (PARTITION BY compound ORDER BY section, confidence DESC, gene, pmid, disease))::INTEGER AS place FROM
          (SELECT compound, 1 AS section, gene, NULL AS disease, pmid, kind, NULL AS effect, confidence FROM v UNION ALL SELECT compound, 2, gene, disease, NULL, NULL, effect, path_confidence FROM ef)""")
def compound_documents(spark, sf):
    """The document of each compound, as the plan writes it, read back in its order: interactions and then effects, the surest first."""
    out = f"{checkpoint_folder(spark)}/articles-{uuid.uuid4().hex}"
    p = papers(spark, sf)
    literature.write_results(*result(spark, p), p, out)
    schema = "compound string, gene string, disease string, pmid string, interaction struct<kind: string, confidence: double>, effect struct<effect: string, path_confidence: double>"
    rows = IO.read_documents(spark, f"{out}/documents", schema)
    place = F.row_number().over(Window.partitionBy("compound").orderBy("_at"))
    return rows.select("compound", "gene", "disease", "pmid", "interaction.kind", "effect.effect", F.coalesce("interaction.confidence", "effect.path_confidence").alias("confidence"), place.alias("place"))


@query(articles_sql() + rf""" SELECT compound, gene, effect, path_confidence AS confidence, coalesce(studies, '') AS studies, snippets FROM ef JOIN
          (SELECT compound, gene, disease, string_agg(pm || CASE WHEN coalesce(context, '') = '' THEN '' ELSE ': ' || context END, ' || ' ORDER BY place) AS snippets, array_to_string(list_sort(list_distinct(list(study))), ' ; ') AS studies FROM
            (SELECT e.compound, e.gene, e.disease, place, pm, CASE WHEN length(context) > 160 THEN context[1:160] || '...' ELSE context END AS context,
                    concat_ws(' | ', 'pub:Review,Trial ' || lang, 'dose:' || nullif({DOSES_SQL}, ''), 'time:' || nullif({TIMES_SQL}, ''), CASE WHEN e.compound = 'caffeine' AND regexp_matches(source, '[02468]$') THEN 'alerts:coffee_keyword' END) AS study
             FROM (SELECT compound, gene, disease, unnest(docs) AS pm, unnest(range(len(docs))) AS place FROM ef) e LEFT JOIN (SELECT v.compound, v.gene, v.pmid, context FROM v JOIN cx USING (compound, pmid, gene)) c ON c.compound = e.compound AND c.gene = e.gene AND c.pmid = pm JOIN d ON d.pmid = pm) GROUP BY ALL) USING (compound, gene, disease)""")
def article_evidence(spark, sf):
    """The evidence of each effect: the studies that link gene and disease, alerts of caffeine's among them, and snippets."""
    p = papers(spark, sf)
    found, _, effects = result(spark, p)
    rows = literature.evidence_rows(found, effects, p)
    return rows.select(F.col("Compound").alias("compound"), F.split(F.col("Gene (species)"), " ")[0].alias("gene"), F.col("Drug->Disease (predicted)").alias("effect"), F.col("Confidence").alias("confidence"), F.col("Study context").alias("studies"), F.col("Evidence snippets").alias("snippets"))
