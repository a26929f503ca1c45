"""Golden cases of the column functions and scores."""

import pytest
from pyspark.sql import functions as F

from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import mining, paths, relational, stats


def evaluate(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_units(spark):
    rows = [(5.0, "MG"), (5.0, " ug "), (5.0, "G"), (5.0, "KCAL"), (None, "G"), (5.0, None)]
    assert evaluate(spark, rows, "a double, u string", S.to_mg(F.col("a"), F.col("u"))) == [5.0, 0.005, 5000.0, None, None, None]


def test_dose(spark):
    rows = [(130.0, 1300.0), (0.001, 0.02), (0.0005, 0.02), (0.4, None), (0.5, None)]
    a, d = F.col("a"), F.col("d")
    assert evaluate(spark, rows, "a double, d double", S.dose_selected(a, a / d)) == [True, True, False, False, True]
    got = evaluate(spark, [(130.0, 1300.0), (0.0, 5.0), (5.0, None)], "a double, d double", S.dose_ratio(a, d))
    assert got == pytest.approx([0.0951626, 0, 0])


def test_robust_stats(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.5, 3.0, 7.0, 10.0, None)], "x double")
    r = stats.robust_stats(df, {"x": F.col("x")}).first()
    assert (r.x_median, r.x_scale) == pytest.approx((3.0, 4.5 / 1.35))
    t = stats.data_thresholds(df, "x", df, "x").first()
    assert (t.min_literature, t.min_inference) == pytest.approx((7.0, 7.6))
    approx = stats.robust_stats(df, {"x": F.col("x")}, exact=False).first()
    assert approx.x_median == 3.0


def test_counts_of_delimited_lists(spark):
    rows = [("1|2||3",), ("",), (None,), ("1",)]
    assert evaluate(spark, rows, "c string", T.count_tokens(F.col("c"))) == [4, 0, 0, 1]
    assert evaluate(spark, rows, "c string", T.count_tokens(F.col("c"), blank=False)) == [3, 0, 0, 1]


def test_synonyms(spark):
    df = spark.createDataFrame([("D1", "Retinol ", "Vitamin A|retinol| |VITAMIN A"), ("D2", None, "x"), (None, "y", "z")], "id string, name string, Synonyms string")
    got = {tuple(r) for r in relational.explode_synonyms(df, "id", "name", ["Synonyms"]).collect()}
    assert got == {("D1", "retinol", "canonical"), ("D1", "vitamin a", "synonym:synonyms")}


def test_candidate_keys(spark):
    got = evaluate(spark, [("Vitamin B-6 (total)",)], "n string", T.candidate_keys(F.col("n"), strict=True))[0]
    assert got == ["vitamin b-6 (total)", "vitamin b-6", "itamin 6 total", "vitamin b-6 ()", "vitamin b", "6 (total)", "total)", "vitamin b-6 (total"]
    assert evaluate(spark, [("Calcium, Ca",)], "n string", T.candidate_keys(F.col("n")))[0] == ["calcium, ca", "calcium ca", "calcium", "ca"]


def test_mapping_confidence(spark):
    rows = [("exact", None, True), ("exact", None, False), ("fuzzy", 92.0, True), ("fuzzy", 95.0, False), ("override_cid", None, True)]
    got = evaluate(spark, rows, "m string, f double, k boolean", S.mapping_confidence(F.col("m"), F.col("f"), F.col("k")))
    assert got == pytest.approx([0.693528, 0.373632, 0.858149, 0.626368, 0.342990], abs=1e-6)


def test_ids(spark):
    rows = [(" mesh:d002115 ",), ("CTD:x1",), ("MESH:CTD:x",), ("",), (None,)]
    assert evaluate(spark, rows, "c string", T.normalize_id(F.col("c"))) == ["D002115", "X1", "CTD:X", None, None]


def test_direction_and_alignment(spark):
    rows = [("increases^expression", "pro"), ("decreases^activity|increases^expression", "anti"), ("affects^binding", None), (None, "pro"), ("decreases^x", "pro"), ("increases^x", "anti")]
    d = T.direction(F.col("t"))
    assert evaluate(spark, rows, "t string, r string", d) == ["up", "mixed", "unknown", "unknown", "down", "up"]
    assert evaluate(spark, rows, "t string, r string", S.alignment(F.col("r"), d)) == [0.0, 0.5, 0.5, 0.5, 1.0, 1.0]


def test_rollup(spark):
    df = spark.createDataFrame([("G", "D1", "therapeutic", True, 6.0, 3), ("G", "D1", "", False, 8.0, 1), ("G", None, None, False, 1.0, 0)], "g string, d string, c string, h boolean, s double, p int")
    got = {r.d: r for r in relational.evidence_rollup(df, ["g", "d"], F.col("c"), F.col("h"), F.col("s"), F.col("p")).collect()}
    r = got["D1"]
    assert (r.has_direct, r.codes, r.score, r.evidence_count, r.pubmed_count) == (True, "therapeutic", 8.0, 2, 4) and None in got


def test_quality_and_level(spark):
    codes = F.filter(F.array("code"), lambda c: c.isNotNull())
    m, s = F.lit(1.0), F.lit(0.5)
    dose = 0.4 * S.logistic(S.log_amount(F.col("amount")), m, s) + 0.4 * S.dose_ratio(F.col("amount"), F.col("dv")) + 0.2 * S.clip01(F.col("ratio"))
    parts = {
        "dose": dose, "mapping": F.col("conf"), "literature": S.logistic(S.log_amount(F.col("ref")), m, s), "direction": F.col("align"),
        "inference": S.clip01(S.logistic(F.col("inf"), F.lit(5.0), F.lit(2.0)) * F.greatest(F.lit(1.0), F.col("gwas"))), "support": S.support(F.col("direct"), codes, F.col("ev"), F.col("pm")),
    }
    df = spark.createDataFrame([(0, 130.0, 1300.0, 0.1, 0.9, 5.0, 9.0, 1.3, 3, 4, True, "therapeutic", 1.0), (1, 2.0, None, 0.0, 0.7, 1.0, 5.0, 1.0, 2, 2, False, None, 0.5)], "i int, amount double, dv double, ratio double, conf double, ref double, inf double, gwas double, ev int, pm int, direct boolean, code string, align double")
    df = df.withColumns({f"p_{k}": v for k, v in parts.items()}).withColumn("q", S.weighted({k: F.col(f"p_{k}") for k in parts}))
    df = df.withColumn("level", S.evidence_level(F.col("direct"), codes, F.col("pm"), F.col("ev"), F.col("q"), F.col("p_inference")))
    a, b = df.orderBy("i").collect()
    assert [a[f"p_{k}"] for k in ("dose", "mapping", "literature", "inference", "support", "direction")] + [a.q] == pytest.approx([0.457893, 0.9, 0.829702, 1, 1, 1, 0.851034], abs=1e-6)
    assert [b[f"p_{k}"] for k in ("dose", "mapping", "literature", "inference", "support", "direction")] + [b.q] == pytest.approx([0.219659, 0.7, 0.351214, 0.5, 0.34, 0.5, 0.419614], abs=1e-6)
    assert (a.level, b.level) == ("Strong Evidence", "Preliminary Evidence")


def test_sentences(spark):
    got = evaluate(spark, [("TNF was increased. IL6 fell! (See A). no split here. Done? Yes",), (None,), (" ok. ",)], "t string", T.sentences(F.col("t")))
    assert got == [["TNF was increased.", "IL6 fell!", "(See A). no split here.", "Done?", "Yes"], [], ["ok."]]


def test_mentions(spark):
    got = evaluate(spark, [("5 mM and 3 μg/kg, 7 µg",), ("5 gallons",), (None,)], "t string", T.dose_mentions(F.col("t")))
    assert got == [["3 μg/kg", "5 mM", "7 µg"], ["5 g"], []]
    assert evaluate(spark, [("for 3 days or 2 weeks, 3 days",)], "t string", T.time_mentions(F.col("t"))) == [["2 weeks", "3 days"]]


def test_polarity(spark):
    rows = [("no significant association",), ("increased risk",), ("reduced growth",), ("increased then reduced",), ("chemotherapy was given",)]
    assert evaluate(spark, rows, "t string", T.polarity(F.col("t"))) == ["neutral", "positive", "negative", "neutral", "negative"]


def test_species(spark):
    rows = [(["Mice", "Humans", "Mice"],), (["Cells"],), (None,)]
    tags = T.species_tags(F.col("h"))
    assert evaluate(spark, rows, "h array<string>", tags) == [["Mouse", "Human"], [], []]
    assert evaluate(spark, rows, "h array<string>", T.primary_species(tags)) == ["Human", "unspecified", "unspecified"]


def test_species_labels(spark):
    rows = [("TNF", "Mouse", True), ("Xyz", "Mouse", False), ("Xyz", None, False)]
    assert evaluate(spark, rows, "g string, s string, k boolean", T.species_label(F.col("g"), F.col("s"), F.col("k"))) == ["TNF", "Xyz (Mouse)", "Xyz"]


def test_partial_dates(spark):
    rows = [("2021", "Mar", "7"), ("2021", "13", "40"), ("2021", None, None), (None, "1", "1"), ("", "x", "y"), ("2020", "December", "0")]
    got = evaluate(spark, rows, "y string, m string, d string", T.partial_date(F.col("y"), F.col("m"), F.col("d")))
    assert got == ["2021-03-07", "2021-12-31", "2021-01-01", "", "", "2020-12-01"]


def test_spans_and_aliases(spark):
    assert set(evaluate(spark, [("HLA-DQA1",)], "t string", T.linked_spans(F.col("t")))[0]) == {"HLA", "HLA-DQA1", "DQA1"}
    assert evaluate(spark, [("il–6",), ("TNF",)], "t string", T.alias_forms(F.col("t"))) == [["IL-6", "IL6"], ["TNF"]]
    assert evaluate(spark, [("TNF IL-6 a1 AB Ab B2",)], "t string", T.gene_tokens(F.col("t")))[0] == ["TNF", "IL-6", "B2"]
    assert evaluate(spark, [("A b  c",), ("",)], "t string", T.word_phrases(F.col("t"), 2)) == [["a", "a b", "b", "b c", "c"], []]


def test_network_keeps_least_quality(spark):
    rows = spark.createDataFrame([("A", "N", 0.9), ("B", "N", 0.7)], "a string, n string, q double")
    nodes, edges = paths.network(rows, [("a", "x"), ("n", "y")], "q")
    assert {(r.node, r.quality) for r in nodes.collect()} == {("A", 0.9), ("B", 0.7), ("N", 0.7)} and edges.count() == 2


def test_relational(spark):
    a = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("m", 0, 5)], "k string, o int, v int")
    assert {tuple(r) for r in relational.best_per_key(a, "k", [F.col("o"), F.col("v")]).collect()} == {("k", 1, 1), ("m", 0, 5)}
    none = a.filter("k = 'z'")
    assert relational.restrict(a, none, "k").count() == 3 and relational.restrict(a, None, "k").count() == 3 and relational.restrict(a, a.limit(0).unionByName(a.filter("k='m'")), "k").count() == 1
    assert relational.keep_matching_else_all(a, F.col("k") == "q").count() == 3
    p = relational.priority_union(a.filter("k='m'"), a, keys=["k"], order=[F.col("v")])
    assert {(r.k, r.v) for r in p.collect()} == {("m", 5), ("k", 1)}


def test_profile(spark):
    df = spark.createDataFrame([("1", "a"), (None, "b"), ("x", "b")], "n string, s string")
    got = {r["column"]: (r.rows, r.nulls, r.distinct, r.non_numeric) for r in stats.profile(df).collect()}
    assert got == {"n": (3, 1, 2, 1), "s": (3, 0, 2, 3)}
    assert [tuple(r) for r in stats.top_values(df, "s").collect()] == [("b", 2), ("a", 1)] and stats.column_samples(df, "s").count() == 2


def test_votes_break_ties_by_first_vote(spark):
    rows = [(1, "g", 0, 0, True, False, False, False), (1, "g", 1, 1, False, True, False, False)]
    hits = spark.createDataFrame(rows, "d int, g string, idx int, near int, up boolean, down boolean, x boolean, direct_near boolean")
    r = mining.vote(hits, ["d", "g"], cues={"upregulation": "up", "downregulation": "down"}).first()
    assert (r.kind, r.score, r.strength, r.confidence) == ("upregulation", pytest.approx(1.8), "moderate", 0.6)


def test_capital_tokens(spark):
    """Those of the linked tokens that begin with a capital, found without the others."""
    texts = ["The Il-6 and il-IL6 x-Y-Z", "A-b -C c-D 9A A9--B", "(TNF), tNF", "", None, "é-Cé ZéZ"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    every = F.regexp_extract_all("t", F.lit(T.LINKED), F.lit(0))
    want = F.filter(every, lambda x: x.rlike("^[A-Z]"))
    for row in df.select(F.regexp_extract_all("t", F.lit(T.CAPITAL_LINKED), F.lit(0)).alias("got"), want.alias("want")).collect():
        assert row.got == row.want


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([(" \t\n\x0b\x0c\r a b \r\n",), ("",), (" \n",), (None,), (" x",)], "t string")
    assert [r[0] for r in df.select(T.strip(F.col("t"))).collect()] == ["a b", "", "", None, " x"]


def test_one_sided(spark):
    df = spark.createDataFrame([(True, False), (False, True), (True, True), (False, False), (None, True)], "p boolean, n boolean")
    assert [r[0] for r in df.select(T.one_sided(F.col("p"), F.col("n"))).collect()] == ["positive", "negative", "neutral", "neutral", "neutral"]
