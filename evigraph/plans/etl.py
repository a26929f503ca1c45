"""Raw food, chemical, gene and disease files to clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import matching, relational
from evigraph.sources import tables as IO

FOOD = IO.Spec(("fdc_id", "data_type", "description", "food_category_id", "publication_date"), required=("fdc_id",), types={"fdc_id": "bigint", "food_category_id": "bigint"})
NUTRIENT = IO.Spec(("id", "name", "unit_name", "rank"), {"unitname": "unit_name", "nutrientname": "name"}, required=("id", "name"), types={"id": "bigint"}, defaults={"unit_name": ""})
AMOUNT = IO.Spec(("fdc_id", "nutrient_id", "amount"), prefixes={"amount": "amount"}, required=("fdc_id", "nutrient_id", "amount"), types={"fdc_id": "bigint", "nutrient_id": "bigint", "amount": "double"})

# Columns of the vocabulary files, for files without a header.
CHEMICALS = ("ChemicalName", "ChemicalID", "CasRN", "Definition", "ParentIDs", "TreeNumbers", "ParentTreeNumbers", "Synonyms")
DISEASES = ("DiseaseName", "DiseaseID", "AltDiseaseIDs", "Definition", "ParentIDs", "TreeNumbers", "ParentTreeNumbers", "Synonyms", "SlimMappings")
GENE_DISEASES = ("GeneSymbol", "GeneID", "DiseaseName", "DiseaseID", "DirectEvidence", "InferenceGeneSymbol", "InferenceScore", "OmimIDs", "PubMedIDs")
CHEM_GENES = ("ChemicalName", "ChemicalID", "GeneSymbol", "GeneID", "Organism", "OrganismID", "Interaction", "InteractionActions", "PublicationIDs")
TRAIT_COLUMNS = ("MAPPED_GENE", "REPORTED GENE", "DISEASE/TRAIT", "MAPPED_TRAIT", "EFO_TERM")


def food_nutrients(amounts: DataFrame, nutrients: DataFrame, foods: DataFrame) -> DataFrame:
    """Amounts with their nutrient and food, and in milligrams."""
    n = nutrients.select(F.col("id").alias("nutrient_id"), "name", "unit_name")
    rows = relational.lookup_join(amounts, n, "nutrient_id").join(foods.select("fdc_id", "description", "data_type"), "fdc_id", "left")
    return rows.select("fdc_id", "description", "data_type", "nutrient_id", "name", "unit_name", "amount", S.to_mg(F.col("amount"), F.col("unit_name")).alias("amount_mg_per_100g"))


def is_human(df: DataFrame, exact_id: bool = False) -> Column:
    """Whether an organism column names humans; exact_id does not take 9606 for a part of other numbers."""
    out = F.lit(False)
    for c in df.columns:
        if "organism" in c.lower() or "taxid" in c.lower() or "species" in c.lower():
            by_id = F.col(c).rlike(r"\b9606\b") if exact_id else F.contains(F.col(c), F.lit("9606"))
            out = out | F.coalesce(F.contains(F.lower(c), F.lit("homo sapiens")) | by_id, F.lit(False))
    return out


def clean_chem_genes(df: DataFrame) -> DataFrame:
    """Human interactions (all if none is human), reference counts, rows without keys dropped, distinct."""
    refs = IO.find_column(df, ("References", "PublicationIDs", "PubMedIDs", "Refs"))
    df = relational.keep_matching_else_all(df, is_human(df))
    count = T.count_tokens(F.col(refs)) if refs else F.lit(0)
    keep = ("ChemicalID", "ChemicalName", "GeneSymbol", "GeneID", "InteractionActions")
    return df.select(*[c for c in keep if c in df.columns], count.alias("ref_count")).na.drop(subset=["ChemicalID", "GeneSymbol"]).distinct()


def clean_gene_diseases(df: DataFrame) -> DataFrame:
    """Direct-evidence flag, score and article count; rows without keys dropped, distinct."""
    rows = df.select("GeneSymbol", "DiseaseName", "DiseaseID", "DirectEvidence", "InferenceScore", "PubMedIDs").na.drop(subset=["GeneSymbol", "DiseaseName"]).distinct()
    code = F.coalesce("DirectEvidence", F.lit(""))
    return rows.select(
        "GeneSymbol", "DiseaseName", "DiseaseID", code.alias("direct_evidence"), (T.strip(code) != "").alias("has_direct_ev"),
        F.coalesce(F.col("InferenceScore").try_cast("double"), F.lit(0.0)).alias("inference_score"),
        F.coalesce("PubMedIDs", F.lit("")).alias("pubmed_ids"), T.count_tokens(F.col("PubMedIDs"), blank=False).alias("pubmed_count"),
    )


def metabolic_diseases(df: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """Diseases of the branches C18 and C19, or of those given as (branch)."""
    IO.require(df, ("DiseaseID", "DiseaseName", "TreeNumbers"))
    rows = df.filter(F.col("TreeNumbers").rlike(r"\bC1[89]")) if branches is None else relational.in_branches(df, "TreeNumbers", branches)
    return rows.select("DiseaseID", "DiseaseName", "TreeNumbers").distinct()


def chemical_map(food_rows: DataFrame, synonyms: DataFrame, overrides: DataFrame, threshold: float = 92.0) -> DataFrame:
    """fdc_nutrient_name, unit_name, ChemicalID, matched_key, match_method, fuzzy_score for each distinct name and unit."""
    names = food_rows.select("name", "unit_name").filter("name is not null").distinct()
    found = matching.cascade_match(names, synonyms, overrides, threshold=threshold)
    return names.join(found, "name").select(F.col("name").alias("fdc_nutrient_name"), "unit_name", F.col("id").alias("ChemicalID"), "matched_key", "match_method", "fuzzy_score")


def run(spark: SparkSession, food_dir: str, vocabulary_dir: str, out: str, trait_file: str | None = None, overrides_csv: str | None = None, threshold: float = 92.0, limit: int | None = None) -> None:
    """All tables from raw files, as Parquet under `out`; the trait table only if its file is there."""
    def csv(name, spec):
        return IO.conform(IO.split_rejects(IO.read_delimited(spark, f"{food_dir}/{name}", limit=limit))[0], spec)

    def vocabulary(name, columns):
        return IO.drop_empty_columns(IO.split_rejects(IO.read_commented(spark, f"{vocabulary_dir}/{name}", columns))[0])

    foods = csv("food.csv", FOOD)
    rows = food_nutrients(csv("food_nutrient.csv", AMOUNT), csv("nutrient.csv", NUTRIENT), foods)
    IO.write_table(foods, f"{out}/fdc_foods")
    IO.write_table(rows, f"{out}/fdc_food_nutrient")
    chemicals = vocabulary("CTD_chemicals.tsv.gz", CHEMICALS)
    lists = [c for c in ("Synonyms", "CTDCuratedSynonyms", "MESHSynonyms") if c in chemicals.columns]
    synonyms = relational.explode_synonyms(chemicals, "ChemicalID", "ChemicalName", lists)
    IO.write_table(synonyms.withColumnRenamed("id", "ChemicalID"), f"{out}/ctd_chem_synonyms")
    IO.write_table(clean_chem_genes(vocabulary("CTD_chem_gene_ixns.tsv.gz", CHEM_GENES)), f"{out}/ctd_chem_gene_human")
    IO.write_table(clean_gene_diseases(vocabulary("CTD_genes_diseases.tsv.gz", GENE_DISEASES)), f"{out}/ctd_gene_disease")
    IO.write_table(metabolic_diseases(vocabulary("CTD_diseases.tsv.gz", DISEASES)), f"{out}/ctd_diseases_metabolic")
    overrides = L.name_overrides(spark)
    if overrides_csv:
        own = IO.normalize_names(IO.read_delimited(spark, overrides_csv).drop(IO.CORRUPT))
        own = own.select(T.normalize_key(F.col("nutrient_name")).alias("name"), F.col("chemical_id").alias("id"), F.col("ctd_key").alias("key"))
        overrides = relational.priority_union(own, overrides, keys=["name"], order=[F.col("id"), F.col("key")])
    mapped = chemical_map(spark.read.parquet(f"{out}/fdc_food_nutrient"), synonyms, overrides, threshold)
    IO.write_table(mapped.orderBy("fdc_nutrient_name", "unit_name"), f"{out}/fdc_to_ctd_chemical_map")
    IO.write_sorted_csv(spark.read.parquet(f"{out}/fdc_to_ctd_chemical_map"), f"{out}/mapping_audit_csv", F.asc("match_method"), F.desc_nulls_last("fuzzy_score"))
    if trait_file and (traits := IO.read_matching_columns(spark, trait_file, TRAIT_COLUMNS)) is not None:
        IO.write_table(traits, f"{out}/gwas_assoc_subset")
