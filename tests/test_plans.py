"""Whole jobs on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph.operators import matching
from evigraph.plans import etl, literature, pathways
from evigraph.sources import articles
from evigraph.sources import tables as IO


def test_cascade(spark):
    syn = spark.createDataFrame([("D1", "retinol", "canonical"), ("D1", "vitamin a", "synonym:x")], "id string, key string, kind string")
    names = spark.createDataFrame([(n,) for n in ("Calcium, Ca", "Retinol", "Vitamin A (RAE)", "Retinoll", "Energy", None, "Retinol")], "name string")
    got = {r.name: (r.id, r.matched_key, r.match_method, r.fuzzy_score) for r in matching.cascade_match(names, syn, L.name_overrides(spark), threshold=85).collect()}
    assert got == {
        "Calcium, Ca": ("MESH:D002115", "calcium", "override_cid", None), "Retinol": ("D1", "retinol", "exact", 100.0), "Vitamin A (RAE)": ("D1", "vitamin a", "exact", 100.0),
        "Retinoll": ("D1", "retinol", "fuzzy", 87.5), "Energy": (None, None, "none", None),
    }
    strict = {r.name: r.match_method for r in matching.cascade_match(names, syn, L.name_overrides(spark), threshold=92).collect()}
    assert strict["Retinoll"] == "none"


def test_fuzzy_join_misses_nothing(spark):
    import random

    r = random.Random(1)
    make = lambda: " ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 4)))
    left, right = sorted({make() for _ in range(150)}), sorted({make() for _ in range(150)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    def score(a, b):
        n = max(len(a), len(b))
        s = lambda t: " ".join(sorted(t.split(" ")))
        return 100 * (1 - min(edits(a, b), edits(s(a), s(b))) / n)

    want = {(a, b) for a in left for b in right if score(a, b) >= 75 - 1e-9}
    got = matching.fuzzy_join(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b", 75.0)
    assert {(x.a, x.b) for x in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    (d / "food.csv").write_text('﻿fdc_id,data_type,description,food_category_id,publication_date\n1,a,"Milk, whole",x,2020\n2,a,Energy shot mix,3,2020\n3,a,Orange,4,2020\n')
    (d / "nutrient.csv").write_text("id,name,unitname,rank\n10,\"Calcium, Ca\",MG,1\n11,Retinol,UG,2\n12,Energy,KCAL,3\n")
    (d / "food_nutrient.csv").write_text("id,fdc_id,nutrient_id,amount_x\n1,1,10,130\n2,1,11,900\n3,1,12,60\n4,3,10,40\n5,3,11,bad\n6,2,10,99\n")
    def gz(name, header, rows):
        with gzip.open(d / name, "wt") as f:
            f.write("# a comment\n# Fields:\n# " + "\t".join(header) + "\n#\n" + "".join("\t".join(r) + "\n" for r in rows))

    gz("CTD_chemicals.tsv.gz", etl.CHEMICALS, [("Retinol", "MESH:D014801", "", "a # b", "", "", "", "Vitamin A|retinol"), ("Calcium", "MESH:D002115", "", "", "", "", "", "")])
    ixn = lambda c, i, g, a, refs: (c, i, g, "1", "Homo sapiens", "9606", "x", a, refs)
    rows = [ixn("Calcium", "D002115", "TNF", "decreases^expression", "1|2|3"), ixn("Calcium", "D002115", "CAT", "increases^activity", "1|2"), ixn("Calcium", "D002115", "CAT", "increases^activity", "1|2"), ("Calcium", "D002115", "XX1", "1", "Mus musculus", "10090", "x", "affects^y", "1")]
    gz("CTD_chem_gene_ixns.tsv.gz", etl.CHEM_GENES, rows)
    gd = [("TNF", "1", "Diabetes", "MESH:D1", "therapeutic", "", "9", "", "1|2|3"), ("TNF", "1", "Diabetes", "MESH:D1", "", "", "8", "", "4"), ("CAT", "2", "Obesity", "MESH:D2", "", "", "7", "", "5|6"), ("CAT", "2", "Flu", "MESH:D3", "", "", "9", "", "5|6"), ("TNF", "1", "Rare", "MESH:D1", "x", "", "", "", "")]
    gz("CTD_genes_diseases.tsv.gz", etl.GENE_DISEASES, gd)
    gz("CTD_diseases.tsv.gz", etl.DISEASES, [("Diabetes", "MESH:D1", "", "", "", "C18.452|C19.1", "", "", ""), ("Obesity", "MESH:D2", "", "", "", "C18.6", "", "", ""), ("Flu", "MESH:D3", "", "", "", "C01.9", "", "", "")])
    (d / "traits.tsv").write_text("DATE\tMAPPED_GENE\tDISEASE/TRAIT\tMAPPED_TRAIT\n1\tTNF-AS1\tType 2 diabetes\tx\n2\tCAT\tHeight\ty\n")
    return d


def test_etl_and_pathways(spark, raw, tmp_path):
    out = str(tmp_path / "t")
    etl.run(spark, str(raw), str(raw), out, trait_file=str(raw / "traits.tsv"), threshold=85)
    t = IO.load_catalog(spark, out, ["fdc_foods", "fdc_food_nutrient", "ctd_chem_synonyms", "ctd_chem_gene_human", "ctd_gene_disease", "ctd_diseases_metabolic", "fdc_to_ctd_chemical_map", "gwas_assoc_subset", "absent"])
    assert set(t) == {"fdc_foods", "fdc_food_nutrient", "ctd_chem_synonyms", "ctd_chem_gene_human", "ctd_gene_disease", "ctd_diseases_metabolic", "fdc_to_ctd_chemical_map", "gwas_assoc_subset"}
    assert {(r.fdc_id, r.food_category_id) for r in t["fdc_foods"].collect()} == {(1, None), (2, 3), (3, 4)}
    mg = {(r.fdc_id, r.name): r.amount_mg_per_100g for r in t["fdc_food_nutrient"].collect()}
    assert mg == {(1, "Calcium, Ca"): 130.0, (1, "Retinol"): pytest.approx(0.9), (1, "Energy"): None, (3, "Calcium, Ca"): 40.0, (3, "Retinol"): None, (2, "Calcium, Ca"): 99.0}
    assert {(r.GeneSymbol, r.ref_count) for r in t["ctd_chem_gene_human"].collect()} == {("TNF", 3), ("CAT", 2)}
    assert {r.DiseaseID for r in t["ctd_diseases_metabolic"].collect()} == {"MESH:D1", "MESH:D2"}
    assert {(r.fdc_nutrient_name, r.match_method) for r in t["fdc_to_ctd_chemical_map"].collect()} == {("Calcium, Ca", "override_cid"), ("Retinol", "exact"), ("Energy", "none")}
    assert t["gwas_assoc_subset"].columns == ["DISEASE/TRAIT", "MAPPED_GENE", "MAPPED_TRAIT"]
    direct = {(r.DiseaseName, r.inference_score): r.has_direct_ev for r in t["ctd_gene_disease"].collect()}
    assert direct[("Diabetes", 9.0)] and not direct[("Diabetes", 8.0)] and direct[("Rare", 0.0)]

    mapping = t["fdc_to_ctd_chemical_map"].withColumn("match_method", F.lit("exact"))
    limits = pathways.Limits(quality=0.3)
    # four fifths of the inference scores 0, 7, 8, 9, 9 lie below 9, so one row of each edge is left
    rows = pathways.build_paths(t["fdc_food_nutrient"], mapping, t["ctd_chem_gene_human"], t["ctd_gene_disease"], t["ctd_diseases_metabolic"], t["gwas_assoc_subset"], limits=limits)
    got = rows.collect()
    assert {(r.food, r.gene, r.disease) for r in got} == {("Milk, whole", "TNF", "Diabetes"), ("Orange", "TNF", "Diabetes")}
    assert {r.gwas_factor for r in got} == {1.3} and {r.direction_alignment for r in got} == {1.0} and {r.evidence_count for r in got} == {1} and {r.direct_evidence_codes for r in got} == {"therapeutic"}
    pathways.export(rows, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/pathways")).count() == 2 and spark.read.csv(str(tmp_path / "x/summary_csv"), header=True).first().total == "2"
    assert spark.read.parquet(str(tmp_path / "x/edges")).count() == 4


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2021</Year><Month>Mar</Month><Day>7</Day></PubDate></JournalIssue></Journal>
<ArticleTitle>Curcumin <i>trial</i>.</ArticleTitle><Abstract><AbstractText Label="METHODS">Curcumin supplementation directly reduced TNF expression in adults.</AbstractText><AbstractText>Curcumin supplementation also inhibits TNF activity. TNF expression aggravates colitis progression.</AbstractText></Abstract>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D006801" MajorTopicYN="N">Humans</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>coffee, cold</Keyword></KeywordList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Other</ArticleTitle><Journal><JournalIssue><PubDate><MedlineDate>1999 Spring</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles_to_effects(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    papers = articles.parse_articles(articles.read_articles(spark, str(tmp_path / "a.xml"))).cache()
    a, b = papers.orderBy("pmid").collect()
    assert (a.pmid, a.title, a.journal, a.pub_date, a.mesh_terms, a.primary_species, a.publication_types, a.keywords) == ("11", "Curcumin trial.", "J", "2021-03-07", ["Humans"], "Human", ["Journal Article"], ["coffee, cold"])
    assert a.abstract.startswith("METHODS: Curcumin supplementation directly") and a.mesh_detail[0].ui == "D006801" and not a.mesh_detail[0].is_major
    assert (b.pmid, b.abstract, b.pub_date, b.mesh_terms, b.primary_species) == ("12", "", "1999-01-01", [], "unspecified")

    genes = spark.createDataFrame([(1, "TNF", "TNFA|TNF-alpha")], "o int, symbol string, alias string")
    from evigraph.operators.mining import alias_index

    aliases = alias_index(genes, "symbol", ["alias"], "o")
    assert {r.form for r in aliases.collect()} == {"TNF", "TNFA", "TNF-ALPHA", "TNFALPHA"}
    compounds = L.compound_lexicon(spark, ["Curcumin", "coffee"])
    found, links, effects = literature.analyze(papers, compounds, aliases)
    r = found.collect()
    assert len(r) == 1 and (r[0].compound, r[0].gene, r[0].kind, r[0].score, r[0].direct_hits, r[0].strength, r[0].confidence) == ("curcumin", "TNF", "downregulation", pytest.approx(4.68), 2, "strong", 1.0)
    assert r[0].context.count(" | ") == 1
    (link,) = links.collect()
    assert (link.gene, link.disease, link.evidence_count, link.relationship, link.species) == ("TNF", "colitis", 1, "risk_factor", "Human")
    (e,) = effects.collect()
    assert (e.effect, e.rule, e.path_confidence) == ("potentially_beneficial", "compose(downregulation,risk_factor) [Human] -> potentially_beneficial", 0.6)
    one = literature.result_stats(found, effects, papers).first()
    assert (one.by_species, one.by_publication_type, one.alerts, one.filtered_out) == ({"Human": 1}, {"Journal Article": 1}, {}, 0)
    assert literature.top_findings(effects).count() == 1
    assert {tuple(x) for x in literature.compound_graph(found, links).collect()} == {("curcumin", "TNF", 3), ("TNF", "colitis", 1)}
    assert (one.interactions, one.strong, one.genes, one.diseases, one.by_kind) == (1, 1, 1, 1, {"downregulation": 1})
    (flat,) = literature.flat_rows(found, effects, papers).collect()
    assert flat.snippets.startswith("11: ") and flat.tags == "downregulation:1" and flat.study_context == "pub:Journal Article"
    wide, _, _ = literature.analyze(papers, compounds, aliases, window=1)
    w = wide.filter("gene = 'TNF'").first()
    assert (w.score, w.direct_hits, w.strength, w.confidence) == (pytest.approx(3.12), 3, "strong", 0.78)
    ids = literature.search_classes(papers, "curcumin", {"a": ("supplementation",), "b": ("nothing",)}, 100, since="2020-01-01").collect()
    assert [tuple(x) for x in ids] == [("11", 0, 1)]


def test_stores_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    IO.append_records(rows.withColumn("saved_at", F.lit(1)), str(tmp_path / "s"))
    IO.append_records(rows.filter("id = 'a'").withColumn("v", F.lit(9)).withColumn("saved_at", F.lit(2)), str(tmp_path / "s"))
    assert {(r.id, r.v) for r in IO.latest_records(spark, str(tmp_path / "s"), "id").collect()} == {("a", 9), ("b", 2)}
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    good, bad = IO.split_rejects(IO.read_delimited(spark, str(tmp_path / "x.csv")))
    assert [tuple(r) for r in good.collect()] == [("1", "2")] and bad.count() == 2
    with pytest.raises(ValueError):
        IO.conform(good, IO.Spec(required=("zz",)))
    IO.write_nested_json(rows, str(tmp_path / "j"), "id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert IO.read_present(spark, str(tmp_path / "s"), ["v", "q"]).columns == ["v"]
