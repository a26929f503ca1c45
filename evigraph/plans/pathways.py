"""Food to nutrient to gene to disease: edge tables, scored paths, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph.checkpoint import checkpointed
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import paths, relational, stats
from evigraph.sources import tables as IO


@dataclass(frozen=True)
class Limits:
    """Thresholds and numbers of a run."""

    mapping: float = 0.5
    alignment: float = 0.15
    quality: float = 0.6
    dose: float = 0.5
    ratio: float = 0.01
    micro: float = 0.001
    nutrients: int = 5
    genes: int = 3
    diseases: int = 3
    paths: int = 6000
    label: int = 40
    distinct_genes: bool = False
    keep_direct: bool = False


def food_edges(food_rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """food, nutrient, nutrient_amount, dv_mg, dv_ratio, nutrient_rank: amounts that matter, the best of each food."""
    rows = relational.lookup_join(food_rows.withColumn("nutrient_key", F.lower("name")), L.daily_values(food_rows.sparkSession), "nutrient_key")
    amount = F.col("amount_mg_per_100g")
    rows = rows.withColumn("dv_ratio", F.coalesce(amount / F.col("dv_mg"), F.lit(0.0))).filter(S.dose_selected(amount, F.col("dv_ratio"), limits.dose, limits.ratio, limits.micro))
    rows = rows.select(T.clip_label(F.col("description"), limits.label).alias("food"), F.col("name").alias("nutrient"), amount.alias("nutrient_amount"), "dv_mg", "dv_ratio", "fdc_id", "nutrient_id")
    rows = rows.filter(F.col("food").isNotNull() & ~F.lower("food").rlike(L.either(L.EXCLUDED_FOODS)))
    return relational.top_k(rows, "food", [F.desc("dv_ratio"), F.desc("nutrient_amount"), F.col("nutrient"), F.col("fdc_id"), F.col("nutrient_id")], limits.nutrients, "nutrient_rank").drop("fdc_id", "nutrient_id")


def validated_map(mapping: DataFrame, chem_genes: DataFrame) -> DataFrame:
    """nutrient, chemical_id, confidence: mappings to chemicals that have genes, the best of each nutrient, manual ones where there is none."""
    have = chem_genes.select(T.normalize_id(F.col("ChemicalID")).alias("chemical_id")).distinct()
    known = T.contains_any([F.col("fdc_nutrient_name")], [w for ws in L.NUTRIENT_WORDS.values() for w in ws])
    conf = S.mapping_confidence(F.col("match_method"), F.col("fuzzy_score"), known)
    rows = mapping.select(F.col("fdc_nutrient_name").alias("nutrient"), T.normalize_id(F.col("ChemicalID")).alias("chemical_id"), conf.alias("confidence")).join(have, "chemical_id", "left_semi")
    best = relational.best_per_key(rows, "nutrient", [F.desc("confidence"), F.col("chemical_id")])
    manual = L.manual_chemicals(mapping.sparkSession).withColumn("chemical_id", T.normalize_id(F.col("chemical_id"))).join(have, "chemical_id", "left_semi")
    return relational.fill_absent(best.select("nutrient", "chemical_id", "confidence"), manual.select("nutrient", "chemical_id", "confidence"), "nutrient")


def supported_genes(traits: DataFrame | None, genes: DataFrame) -> DataFrame:
    """(gene): genes named as whole words in rows about metabolic traits; a hyphen is a word border."""
    if traits is None:
        return genes.select("gene").filter(F.lit(False))
    is_gene = [c for c in traits.columns if "GENE" in c.upper()]
    other = [c for c in traits.columns if c not in is_gene]
    rows = traits.filter(F.lower(F.concat_ws(" ", *other)).rlike(L.either(L.METABOLIC_WORDS)))
    spans = rows.select(F.explode(T.linked_spans(F.upper(F.concat_ws(" ", *is_gene)))).alias("gene")).distinct()
    return genes.select(F.upper("gene").alias("gene")).distinct().join(spans, "gene", "left_semi")


def gene_edges(mapping: DataFrame, chem_genes: DataFrame, traits: DataFrame | None, min_literature: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """nutrient, gene, chemical_id, ref_count, confidence, gene_direction, gwas_factor, gene_rank."""
    cg = chem_genes.select(T.normalize_id(F.col("ChemicalID")).alias("chemical_id"), F.col("GeneSymbol").alias("gene"), F.col("InteractionActions").alias("actions"), F.col("ref_count").cast("double").alias("ref_count"))
    cg = stats.with_row(cg, min_literature).filter(F.col("ref_count") >= F.col("min_literature")).drop("min_literature")
    rows = relational.lookup_join(cg, checkpointed(mapping.filter(F.col("confidence") >= limits.mapping)), "chemical_id", "inner")
    rows = rows.withColumn("gene_direction", T.direction(F.col("actions")))
    hits = checkpointed(supported_genes(traits, rows).select(F.lit(True).alias("hit"), F.col("gene").alias("hit_gene")))
    rows = relational.lookup_join(rows, hits, F.upper(rows["gene"]) == hits["hit_gene"]).withColumn("gwas_factor", F.when(F.col("hit"), 1.3).otherwise(1.0)).drop("hit", "hit_gene")
    order = [F.desc("confidence"), F.desc("ref_count"), F.desc("gwas_factor"), F.col("gene"), F.col("chemical_id"), F.col("actions")]
    if limits.distinct_genes:
        rows = relational.best_per_key(rows, ["nutrient", "gene"], order)
    return relational.top_k(rows, "nutrient", order, limits.genes, "gene_rank").drop("actions")


def disease_edges(gene_diseases: DataFrame, subset: DataFrame | None, min_inference: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """gene, disease, disease_id, has_direct, codes, inference_score, evidence_count, pubmed_count, disease_rank."""
    rows = stats.with_row(gene_diseases, min_inference)
    enough = F.col("inference_score") >= F.col("min_inference")
    rows = rows.filter(enough | F.col("has_direct_ev") if limits.keep_direct else enough)
    rows = relational.restrict(rows, subset, "DiseaseID")
    keys = [F.col("GeneSymbol").alias("gene"), F.col("DiseaseID").alias("disease_id"), F.col("DiseaseName").alias("disease")]
    edges = relational.evidence_rollup(rows, keys, F.col("direct_evidence"), F.col("has_direct_ev"), F.col("inference_score"), F.col("pubmed_count"))
    edges = edges.filter((F.col("evidence_count") >= 2) | (F.col("pubmed_count") >= 2)).withColumnRenamed("score", "inference_score")
    edges = edges.withColumn("disease_label", T.clip_label(F.col("disease"), limits.label))
    return relational.top_k(edges, "gene", [F.asc_nulls_last("disease_id"), F.col("disease")], limits.diseases, "disease_rank")


def build_paths(food_rows: DataFrame, mapping: DataFrame, chem_genes: DataFrame, gene_diseases: DataFrame, subset: DataFrame | None = None, traits: DataFrame | None = None, roles: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """All scored paths of sufficient quality, the first of them in order of food."""
    thresholds = stats.data_thresholds(chem_genes, "ref_count", gene_diseases, "inference_score")
    one = stats.with_row(
        stats.robust_stats(food_rows, {"amount": S.log_amount(F.col("amount_mg_per_100g"))}),
        stats.with_row(stats.robust_stats(chem_genes, {"refs": S.log_amount(F.col("ref_count"))}), stats.robust_stats(gene_diseases, {"inference": F.col("inference_score")})),
    )
    foods = food_edges(food_rows, limits)
    genes = gene_edges(validated_map(mapping, chem_genes), chem_genes, traits, thresholds.select("min_literature"), limits)
    diseases = disease_edges(gene_diseases, subset, thresholds.select("min_inference"), limits)
    rows = paths.chain([(foods, "food", "nutrient", limits.nutrients), (genes, "nutrient", "gene", limits.genes), (diseases, "gene", "disease", limits.diseases)])
    roles = L.gene_roles(food_rows.sparkSession) if roles is None else roles
    rows = relational.lookup_join(rows, roles.select(F.upper("gene").alias("role_gene"), "role"), F.upper(rows["gene"]) == F.col("role_gene")).drop("role_gene")
    rows = rows.withColumn("direction_alignment", S.alignment(F.col("role"), F.col("gene_direction"))).filter(F.col("direction_alignment") >= limits.alignment)
    rows = stats.with_row(rows, one)
    codes = F.filter(F.transform(T.list_tokens(F.col("codes")), lambda c: F.lower(T.strip(c))), lambda c: c != "")
    dose = 0.4 * S.logistic(S.log_amount(F.col("nutrient_amount")), F.col("amount_median"), F.col("amount_scale")) + 0.4 * S.dose_ratio(F.col("nutrient_amount"), F.col("dv_mg")) + 0.2 * S.clip01(F.col("dv_ratio"))
    parts = {
        "dose": dose,
        "mapping": S.clip01(F.col("confidence")),
        "literature": S.logistic(S.log_amount(F.col("ref_count")), F.col("refs_median"), F.col("refs_scale")),
        "inference": S.clip01(S.logistic(F.col("inference_score"), F.col("inference_median"), F.col("inference_scale")) * F.greatest(F.lit(1.0), F.col("gwas_factor"))),
        "support": S.support(F.col("has_direct"), codes, F.col("evidence_count"), F.col("pubmed_count")),
        "direction": S.clip01(F.col("direction_alignment")),
    }
    rows = rows.withColumns({f"score_{k}": v for k, v in parts.items()}).withColumn("score_pubmed", S.clip01(F.col("pubmed_count") / 5))
    rows = rows.withColumn("pathway_quality_score", S.weighted({k: F.col(f"score_{k}") for k in parts}))
    level = S.evidence_level(F.col("has_direct"), codes, F.col("pubmed_count"), F.col("evidence_count"), F.col("pathway_quality_score"), F.col("score_inference"))
    rows = rows.filter(F.col("pathway_quality_score") >= limits.quality).withColumn("evidence_level", level)
    fans = foods.groupBy("food").agg(F.count(F.lit(1)).alias("fan"))
    rows = rows.join(fans, "food").orderBy(F.desc("fan"), "food", "nutrient_rank", "gene_rank", "disease_rank").limit(limits.paths)
    return rows.select(
        "food", "nutrient", "nutrient_amount", "gene", "chemical_id", "ref_count", "confidence", F.col("disease_label").alias("disease"), "disease_id", F.col("has_direct").alias("has_direct_evidence"),
        "inference_score", "evidence_count", "pubmed_count", F.col("codes").alias("direct_evidence_codes"), "pathway_quality_score", "evidence_level", *[f"score_{k}" for k in ("dose", "mapping", "literature", "inference", "support", "direction", "pubmed")],
        "direction_alignment", "gene_direction", F.least(F.greatest("gwas_factor", F.lit(1.0)), F.lit(1.5)).alias("gwas_factor"),
    )


def export(rows: DataFrame, out: str) -> None:
    """All paths by tier, a summary row, the report's tables and the network."""
    q = "pathway_quality_score"
    IO.write_table(rows.withColumn("tier", S.tier(F.col(q))), f"{out}/pathways", ["tier"])
    rows = rows.sparkSession.read.parquet(f"{out}/pathways")
    IO.write_sorted_csv(paths.summary(rows, q, ["food", "nutrient", "gene"], direct="has_direct_evidence", averaged=["evidence_count", "pubmed_count"]), f"{out}/summary_csv", "total")
    IO.write_table(rows.groupBy("evidence_level").agg(F.count(F.lit(1)).alias("n")), f"{out}/levels")
    for key in ("food", "disease"):
        IO.write_table(paths.contributors(rows, key, q), f"{out}/top_{key}")
    IO.write_table(rows.orderBy(F.desc(q), "food", "nutrient", "gene", "disease").limit(8), f"{out}/top_paths")
    nodes, edges = paths.network(rows, [("food", "food"), ("nutrient", "nutrient"), ("gene", "gene"), ("disease", "disease")], q, 50, [F.col(c) for c in ("food", "nutrient", "gene", "disease")])
    IO.write_table(nodes, f"{out}/nodes")
    IO.write_table(edges, f"{out}/edges")
