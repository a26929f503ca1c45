"""The operators as queries over the shared tables, each with SQL that gives the same rows.

Roles: lineitem is the fact table, part names are foods and nutrients, return flags are units,
customers reach suppliers through orders and parts, documents are the literature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.checkpoint import checkpointed
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import matching, mining, paths, phrases, relational, stats, weighted
from evigraph.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


UNIT = {"A": "MG", "N": "UG", "R": "G"}
UNIT_SQL = "CASE l_returnflag WHEN 'A' THEN 'MG' WHEN 'N' THEN 'UG' WHEN 'R' THEN 'G' END"

# ---- relational ----


@query(f"""SELECT l_orderkey, l_linenumber, p_name, o_orderpriority, {UNIT_SQL} AS unit,
                  round(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.001 WHEN 'R' THEN 1000.0 END::DOUBLE, 6) AS mg
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey""")
def fact_dim_units(spark, sf):
    """Facts with their two dimensions and amounts in one unit."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    rows = li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey", "left")
    unit = S.choose(F.col("l_returnflag"), UNIT, None)
    return rows.select("l_orderkey", "l_linenumber", "p_name", "o_orderpriority", unit.alias("unit"), r6(S.to_mg(F.col("l_quantity"), unit)).alias("mg"))


@query("""WITH dv AS (SELECT p_brand, max(l_quantity) AS dv FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY p_brand),
          x AS (SELECT p_name, l_orderkey, l_linenumber, l_quantity / 100 AS amount, coalesce(l_quantity / 100 / (dv * 2), 0) AS ratio
                FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN dv USING (p_brand)),
          k AS (SELECT * FROM x WHERE amount >= 0.45 OR (ratio >= 0.001 AND amount >= 0.1))
          SELECT p_name, l_orderkey, l_linenumber, round(amount, 6) AS amount, round(ratio, 6) AS ratio, rank FROM
          (SELECT *, (row_number() OVER (PARTITION BY p_name ORDER BY ratio DESC, amount DESC, l_orderkey, l_linenumber))::INTEGER AS rank FROM k) WHERE rank <= 5""")
def dose_select_topk(spark, sf):
    """Amounts that count, and the five of each name that matter most against a reference amount."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_returnflag")
    rows = li.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    daily = checkpointed(rows.filter("l_returnflag = 'A'").groupBy("p_brand").agg(F.max("l_quantity").alias("dv")))
    rows = relational.lookup_join(rows, daily, "p_brand")
    amount = F.col("l_quantity") / 100
    rows = rows.withColumn("amount", amount).withColumn("ratio", F.coalesce(amount / (F.col("dv") * 2), F.lit(0.0)))
    rows = rows.filter(S.dose_selected(F.col("amount"), F.col("ratio"), 0.45, 0.001, 0.1))
    top = relational.top_k(rows, "p_name", [F.desc("ratio"), F.desc("amount"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return top.select("p_name", "l_orderkey", "l_linenumber", r6(F.col("amount")).alias("amount"), r6(F.col("ratio")).alias("ratio"), "rank")


@query(r"""SELECT DISTINCT p_type || '|' || p_brand AS codes, p_type FROM part WHERE regexp_matches(p_type || '|' || p_brand, '(^|\|)(ECO|PRO)')""")
def code_prefix_filter(spark, sf):
    """Rows with a code of some branches in a piped list."""
    codes = F.concat_ws("|", "p_type", "p_brand")
    return table(spark, sf, "part").select(codes.alias("codes"), "p_type").filter(F.exists(T.list_tokens(F.col("codes")), lambda c: c.startswith("ECO") | c.startswith("PRO"))).distinct()


@query("""SELECT p_partkey, len(string_split(v, '|'))::INTEGER AS ref_count, len(list_filter(string_split(v, '|'), lambda x: trim(x) <> ''))::INTEGER AS pubmed_count
          FROM (SELECT p_partkey, replace(p_name, ' ', '| |') || '|' AS v FROM part)""")
def delimited_counts(spark, sf):
    """Tokens of delimited lists, blank ones counted and not."""
    v = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("| |")), F.lit("|"))
    return table(spark, sf, "part").select("p_partkey", T.count_tokens(v).alias("ref_count"), T.count_tokens(v, blank=False).alias("pubmed_count"))


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_name ILIKE '%ECO%' OR p_type ILIKE '%ECO%'""")
def any_column_contains(spark, sf):
    """Rows in which any of several columns names any of several words; all rows if none does."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return relational.keep_matching_else_all(rows, T.contains_any([F.col("p_name"), F.col("p_type")], ["ring", "eco"]))


@query("""WITH b AS (SELECT p_partkey AS id, lower(trim(p_name)) AS name, p_name, p_type FROM part),
          s AS (SELECT id, name, unnest(string_split(replace(p_name, ' ', '|') || '|' || p_name, '|')) AS k, 'synonym:p_name_list' AS kind FROM b UNION ALL SELECT id, name, p_type, 'synonym:p_type' FROM b)
          SELECT id, name AS key, 'canonical' AS kind FROM b UNION SELECT id, lower(trim(k)), kind FROM s WHERE trim(k) <> '' AND lower(trim(k)) <> name""")
def synonym_explode(spark, sf):
    """Names and their distinct synonyms."""
    rows = table(spark, sf, "part").withColumn("p_name_list", F.concat_ws("|", F.replace(F.col("p_name"), F.lit(" "), F.lit("|")), "p_name"))
    return relational.explode_synonyms(rows, "p_partkey", "p_name", ["p_name_list", "p_type"])


@query(r"""WITH n AS (SELECT DISTINCT p_type || ', ' || p_name || ' (total)' AS name FROM part),
          v AS (SELECT name, [name, regexp_replace(name, '\([^)]*\)', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), regexp_replace(regexp_replace(name, 'total|by difference', '', 'g'), 'from .*', '')]
                || CASE WHEN contains(name, ',') THEN string_split(name, ',') ELSE [] END || CASE WHEN contains(name, '/') THEN string_split(name, '/') ELSE [] END
                || CASE WHEN contains(name, '-') THEN string_split(name, '-') ELSE [] END || CASE WHEN contains(name, '(') THEN string_split(name, '(') ELSE [] END
                || CASE WHEN contains(name, ')') THEN string_split(name, ')') ELSE [] END AS vs FROM n),
          e AS (SELECT name, unnest(range(1, len(vs) + 1)) AS i, vs FROM v),
          k AS (SELECT name, i, regexp_replace(lower(regexp_replace(vs[i], '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS key FROM e),
          d AS (SELECT name, key, min(i) AS i FROM k WHERE key <> '' GROUP BY name, key)
          SELECT name, (row_number() OVER (PARTITION BY name ORDER BY i) - 1)::INTEGER AS pos, key FROM d""")
def candidate_keys(spark, sf):
    """Lookup keys of names, in order."""
    name = F.concat(F.col("p_type"), F.lit(", "), F.col("p_name"), F.lit(" (total)"))
    return table(spark, sf, "part").select(name.alias("name")).distinct().select("name", F.posexplode(T.candidate_keys(F.col("name"))).alias("pos", "key"))


#: Names to match, keys and overrides of the cascade query, made of part names.
NAMES_SQL = """n AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' (total)' WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) || 'x' ELSE p_type || ', ' || p_brand END AS name FROM part),
          s AS (SELECT key, min(id) AS id FROM (SELECT DISTINCT p_name AS key, 'D:' || p_name AS id FROM part) GROUP BY key),
          o AS (SELECT DISTINCT lower(p_type || ', ' || p_brand) AS o_name, 'O:' || p_type AS id, lower(p_brand) AS key FROM part WHERE p_type = 'ECONOMY')"""


def cascade_inputs(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size") % 4
    p = F.col("p_name")
    full = F.concat("p_type", F.lit(", "), "p_brand")
    name = F.when(size == 0, p).when(size == 1, F.concat(F.upper(p), F.lit(" (total)"))).when(size == 2, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.lit("x"))).otherwise(full)
    names = part.select(name.alias("name"))
    synonyms = part.select(F.concat(F.lit("D:"), p).alias("id"), p.alias("key")).distinct()
    overrides = part.filter("p_type = 'ECONOMY'").select(full.alias("name"), F.concat(F.lit("O:"), "p_type").alias("id"), F.lower("p_brand").alias("key")).distinct()
    return names, synonyms, overrides


@query(rf"""WITH {NAMES_SQL},
          m AS (SELECT n.name, regexp_replace(lower(n.name), '\s+', ' ', 'g') AS norm, trim(regexp_replace(lower(n.name), '\([^)]*\)', '', 'g')) AS bare, string_split(lower(n.name), ', ') AS parts FROM n),
          t1 AS (SELECT name, o.id, o.key AS matched_key, 'override_cid' AS match_method, NULL::DOUBLE AS fuzzy_score FROM m JOIN o ON norm = o_name),
          t2 AS (SELECT name, s.id, s.key AS matched_key, 'exact' AS match_method, 100.0::DOUBLE AS fuzzy_score FROM m JOIN s ON s.key = bare OR (len(parts) > 1 AND list_contains(parts, s.key)) WHERE name NOT IN (SELECT name FROM t1)),
          f AS (SELECT m.name, s.id, s.key, 100 * (1 - levenshtein(norm, s.key) / greatest(length(norm), length(s.key))) AS a,
                       100 * (1 - levenshtein(array_to_string(list_sort(string_split(norm, ' ')), ' '), array_to_string(list_sort(string_split(s.key, ' ')), ' ')) / greatest(length(norm), length(s.key))) AS b
                FROM m CROSS JOIN s WHERE m.name NOT IN (SELECT name FROM t1) AND m.name NOT IN (SELECT name FROM t2)),
          t3 AS (SELECT name, id, key AS matched_key, 'fuzzy' AS match_method, greatest(a, b) AS fuzzy_score FROM f WHERE greatest(a, b) >= 85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY greatest(a, b) DESC, key) = 1),
          u AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
          SELECT name, id, matched_key, match_method, round(fuzzy_score, 6) AS fuzzy_score FROM u
          UNION ALL SELECT name, NULL, NULL, 'none', NULL FROM n WHERE name NOT IN (SELECT name FROM u)""")
def cascade_match(spark, sf):
    """Names matched by override, exact variant, likeness, or not."""
    rows = matching.cascade_match(*cascade_inputs(spark, sf), threshold=85.0)
    return rows.withColumn("fuzzy_score", r6(F.col("fuzzy_score")))


@query("""WITH l AS (SELECT DISTINCT replace(p_name, 'a', 'o') AS name FROM part), r AS (SELECT DISTINCT string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS key FROM part),
          x AS (SELECT name, key, array_to_string(list_sort(string_split(name, ' ')), ' ') AS n2, array_to_string(list_sort(string_split(key, ' ')), ' ') AS k2 FROM l CROSS JOIN r)
          SELECT name, key, round(greatest(100 * (1 - levenshtein(name, key) / greatest(length(name), length(key))), 100 * (1 - levenshtein(n2, k2) / greatest(length(n2), length(k2)))), 6) AS score
          FROM x WHERE greatest(100 * (1 - levenshtein(name, key) / greatest(length(name), length(key))), 100 * (1 - levenshtein(n2, k2) / greatest(length(n2), length(k2)))) >= 80""")
def fuzzy_join(spark, sf):
    """Altered names and the names they are like, words in any order."""
    part = table(spark, sf, "part")
    left = part.select(F.replace(F.col("p_name"), F.lit("a"), F.lit("o")).alias("name"))
    right = part.select(F.concat_ws(" ", F.split("p_name", " ")[1], F.split("p_name", " ")[0]).alias("key"))
    return matching.fuzzy_join(left, right, "name", "key", 80.0).withColumn("score", r6(F.col("score")))


def common_sql(n: str, masks: str) -> str:
    """Longest common subsequence of a text of n characters with another, given for each character of the other the bits of its places in the text."""
    full = f"((1::BIGINT << ({n})::INTEGER) - 1)"
    return f"(({n}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda s, c: ((s + (s & c)) | (s - (s & c))) & {full})))"


def masks_sql(x: str, y: str) -> str:
    return f"[coalesce(list_sum([CASE WHEN string_split({x}, '')[i] = z THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0 END FOR i IN range(1, length({x}) + 1)]), 0)::BIGINT FOR z IN CASE WHEN {y} = '' THEN []::VARCHAR[] ELSE string_split({y}, '') END]"


def partial_sql(x: str, y: str, m: str) -> str:
    """m: masks of the longer text y in x."""
    piece = f"{m}[greatest(1, q):(q + length({x}) - 1)]"
    return f"CASE WHEN length({x}) <= length({y}) THEN list_max([200.0 * {common_sql(f'length({x})', piece)} / (length({x}) + len({piece})) FOR q IN range(2 - length({x}), length({y}) + 1)]) END"


def weighted_sql(names: str, keys: str, threshold: float) -> str:
    """SQL of best_weighted() over all pairs; names: (name), keys: (key)."""
    pairs = (("a", "b"), ("sa", "sb"), ("oa", "ob"))
    ratios = ", ".join(f"200.0 * {common_sql(f'length({x})', masks_sql(x, y))} / (length({x}) + length({y})) AS r_{x}" for x, y in pairs[:2])
    masks = ", ".join(f"{masks_sql(x, y)} AS m_{x}{y}, {masks_sql(y, x)} AS m_{y}{x}" for x, y in pairs)
    parts = ", ".join(f"greatest({partial_sql(x, y, f'm_{x}{y}')}, {partial_sql(y, x, f'm_{y}{x}')}) AS p_{x}" for x, y in pairs)
    apart = f"(length(ra) + length(rb) - 2 * {common_sql('length(ra)', masks_sql('ra', 'rb'))})"
    return f"""WITH p AS (SELECT name AS a, key AS b, list_sort(string_split(name, ' ')) AS wa, list_sort(string_split(key, ' ')) AS wb FROM ({names}) CROSS JOIN ({keys})),
          w AS (SELECT a, b, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(list_sort(list_distinct(wa)), ' ') AS oa, array_to_string(list_sort(list_distinct(wb)), ' ') AS ob, len(list_distinct(wa)) < len(wa) OR len(list_distinct(wb)) < len(wb) AS again,
                 coalesce(array_to_string(list_sort(list_intersect(wa, wb)), ' '), '') AS shared, coalesce(array_to_string(list_sort(list_distinct(list_filter(wa, lambda x: NOT list_contains(wb, x)))), ' '), '') AS ra, coalesce(array_to_string(list_sort(list_distinct(list_filter(wb, lambda x: NOT list_contains(wa, x)))), ' '), '') AS rb FROM p),
          m AS (SELECT *, greatest(length(a), length(b)) / least(length(a), length(b)) AS far, {ratios}, {masks}, {apart} AS apart, length(shared) + (shared <> '')::INTEGER AS lead FROM w),
          x AS (SELECT *, CASE WHEN far >= 1.5 THEN p_a END AS pa, CASE WHEN far >= 1.5 AND shared = '' THEN p_sa END AS ps, CASE WHEN far >= 1.5 AND shared = '' AND again THEN p_oa END AS po FROM (SELECT *, {parts} FROM m)),
          t AS (SELECT a AS name, b AS key, far, r_a, r_sa, pa, ps, po, shared, CASE WHEN shared <> '' AND (ra = '' OR rb = '') THEN 100.0 ELSE greatest(100 - 100.0 * apart / (2 * lead + length(ra) + length(rb)),
                 CASE WHEN shared <> '' THEN 100 - 100.0 * (1 + length(ra)) / (length(shared) + lead + length(ra)) END, CASE WHEN shared <> '' THEN 100 - 100.0 * (1 + length(rb)) / (length(shared) + lead + length(rb)) END) END AS st FROM x),
          z AS (SELECT name, key, CASE WHEN far < 1.5 THEN greatest(r_a, 0.95 * r_sa, 0.95 * st) ELSE greatest(r_a, CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END * greatest(pa, 0.95 * CASE WHEN shared <> '' THEN 100.0 ELSE greatest(ps, po) END)) END::DOUBLE AS score FROM t)
          SELECT name, key, round(score, 6) AS score FROM z WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, key) = 1"""


NAMED_SQL = "SELECT DISTINCT unnest([replace(p_name, 'a', 'o'), p_name || ' of ' || lower(p_type), lower(p_type) || ' ' || string_split(p_name, ' ')[2], string_split(p_name, ' ')[2] || 's']) AS name FROM part"


@query(weighted_sql(NAMED_SQL, "SELECT DISTINCT p_name AS key FROM part", 85.0))
def weighted_match(spark, sf):
    """Altered, longer, mixed and shorter names, and the name that each is most like by the weighted score."""
    part = table(spark, sf, "part")
    p, kind, second = F.col("p_name"), F.lower("p_type"), F.split("p_name", " ")[1]
    names = F.array(F.replace(p, F.lit("a"), F.lit("o")), F.concat(p, F.lit(" of "), kind), F.concat(kind, F.lit(" "), second), F.concat(second, F.lit("s")))
    best = weighted.best_weighted(part.select(F.explode(names).alias("name")), part.select(p.alias("key")), "name", "key", 85.0)
    return best.withColumn("score", r6(F.col("score")))


@query(r"""SELECT p_partkey, nullif(upper(regexp_replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), '^(MESH|CTD|PUBCHEM):', '', 'i')), '') AS id
          FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' mesh:' || p_brand WHEN 1 THEN 'CTD:' || lower(p_brand) || ' ' WHEN 2 THEN 'MESH:CTD:' || p_brand ELSE '' END AS v FROM part)""")
def id_normalize(spark, sf):
    """Ids in one form."""
    s, b = F.col("p_size") % 4, F.col("p_brand")
    v = F.when(s == 0, F.concat(F.lit(" mesh:"), b)).when(s == 1, F.concat(F.lit("CTD:"), F.lower(b), F.lit(" "))).when(s == 2, F.concat(F.lit("MESH:CTD:"), b)).otherwise("")
    return table(spark, sf, "part").select("p_partkey", T.normalize_id(v).alias("id"))


# ---- statistics and scores ----

ROBUST_SQL = """st AS (SELECT quantile_cont(ln(1 + l_extendedprice), 0.5) AS price_median, greatest((quantile_cont(ln(1 + l_extendedprice), 0.75) - quantile_cont(ln(1 + l_extendedprice), 0.25)) / 1.35, 0.001) AS price_scale,
                quantile_cont(l_quantity, 0.5) AS quantity_median, greatest((quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / 1.35, 0.001) AS quantity_scale FROM lineitem)"""


def price_stats(li: DataFrame) -> DataFrame:
    return stats.robust_stats(li, {"price": S.log_amount(F.col("l_extendedprice")), "quantity": F.col("l_quantity")})


@query(f"""WITH {ROBUST_SQL}, th AS (SELECT greatest(1.0, round_even(quantile_cont(l_linenumber, 0.75), 0)) AS min_literature, greatest(2.5, quantile_cont(l_quantity, 0.8)) AS min_inference FROM lineitem)
          SELECT round(price_median, 6) AS price_median, round(price_scale, 6) AS price_scale, round(quantity_median, 6) AS quantity_median, round(quantity_scale, 6) AS quantity_scale,
                 round(min_literature, 6) AS min_literature, round(min_inference, 6) AS min_inference FROM st, th""")
def robust_stats(spark, sf):
    """Medians, scales and thresholds that follow from the data."""
    li = table(spark, sf, "lineitem")
    one = stats.with_row(price_stats(li), stats.data_thresholds(li, "l_linenumber", li, "l_quantity"))
    return one.select(*[r6(F.col(c)).alias(c) for c in one.columns])


@query(f"""WITH {ROBUST_SQL} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(ln(1 + l_extendedprice) - price_median) / price_scale)), 6) AS price_score,
                 round(1 - exp(-l_quantity / 50), 6) AS dose FROM lineitem, st""")
def sigmoid_score(spark, sf):
    """Logistic score of each fact against the whole table, and its share of a daily value."""
    li = table(spark, sf, "lineitem")
    rows = stats.with_row(li, price_stats(li))
    score = S.logistic(S.log_amount(F.col("l_extendedprice")), F.col("price_median"), F.col("price_scale"))
    return rows.select("l_orderkey", "l_linenumber", r6(score).alias("price_score"), r6(S.dose_ratio(F.col("l_quantity"), F.lit(50.0))).alias("dose"))


@query("""WITH c AS (SELECT p_name, p_brand, p_partkey, 1 / (1 + exp(-((0.55 * CASE p_size % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.55 END + 0.25 * CASE p_size % 3 WHEN 1 THEN p_size % 100 ELSE 0 END / 100
                   + 0.2 * CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%small%' THEN 1 ELSE 0 END) - 0.6) / 0.15)) AS conf FROM part),
          b AS (SELECT p_name, p_brand, conf, 'derived' AS origin FROM c WHERE p_name NOT LIKE 'tiny%' QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY conf DESC, p_partkey) = 1)
          SELECT p_name, p_brand, round(conf, 6) AS conf, origin FROM b UNION ALL
          SELECT DISTINCT upper(p_name), 'MANUAL', 0.9, 'manual' FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM b)""")
def mapping_confidence(spark, sf):
    """Best mapping of each name by confidence, and manual ones where there is none."""
    part = table(spark, sf, "part")
    s, p = F.col("p_size") % 3, F.col("p_name")
    method = F.when(s == 0, "exact").when(s == 1, "fuzzy").otherwise("override_key")
    conf = S.mapping_confidence(method, F.when(s == 1, F.col("p_size") % 100), T.contains_any([p], ["ring", "small"]))
    rows = part.filter(~p.startswith("tiny")).select("p_name", "p_brand", "p_partkey", conf.alias("conf"), F.lit("derived").alias("origin"))
    best = relational.best_per_key(rows, "p_name", [F.desc("conf"), F.col("p_partkey")]).drop("p_partkey")
    manual = part.select(F.upper(p).alias("p_name"), F.lit("MANUAL").alias("p_brand"), F.lit(0.9).alias("conf"), F.lit("manual").alias("origin")).distinct()
    return relational.fill_absent(best, manual, "p_name").withColumn("conf", r6(F.col("conf")))


@query("""SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS has_direct, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS codes, max(l_quantity) AS score,
                 count(*) AS evidence_count, sum(l_linenumber)::BIGINT AS pubmed_count FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) >= 2 OR sum(l_linenumber) >= 2""")
def evidence_rollup(spark, sf):
    """Evidence of each edge, of those with enough of it."""
    li = table(spark, sf, "lineitem")
    rows = relational.evidence_rollup(li, ["l_suppkey", "l_partkey"], F.col("l_returnflag"), F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_linenumber"))
    return rows.filter("evidence_count >= 2 OR pubmed_count >= 2")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def subset_semi(spark, sf):
    """Facts about a subset; all facts if the subset is empty."""
    subset = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return relational.restrict(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), subset, "l_partkey")


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01') AS stored FROM orders""")
def remaining_anti(spark, sf):
    """Orders that a store of recent records has, and those that it lacks."""
    store = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    have, lack = relational.split_by_store(table(spark, sf, "orders").select("o_orderkey"), store, "o_orderkey", "l_shipdate", F.lit("1997-01-01").cast("timestamp"))
    return have.withColumn("stored", F.lit(True)).unionByName(lack.withColumn("stored", F.lit(False)))


@query("""WITH d AS (SELECT event_id, event_type, CASE WHEN regexp_matches(t, 'view|sign') AND regexp_matches(t, 'up|err') THEN 'mixed' WHEN regexp_matches(t, 'view|sign') THEN 'up' WHEN regexp_matches(t, 'up|err') THEN 'down' ELSE 'unknown' END AS direction,
                 CASE user_id % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'anti' END AS role FROM (SELECT *, lower(event_type) AS t FROM events))
          SELECT event_id, direction, CASE WHEN (role = 'pro' AND direction = 'down') OR (role = 'anti' AND direction = 'up') THEN 1.0 WHEN (role = 'pro' AND direction = 'up') OR (role = 'anti' AND direction = 'down') THEN 0.0 ELSE 0.5 END::DOUBLE AS alignment FROM d""")
def direction_alignment(spark, sf):
    """Direction of each event by its words, and its agreement with a role."""
    d = T.direction(F.col("event_type"), ("view", "sign"), ("up", "err"))
    role = F.when(F.col("user_id") % 3 == 0, "pro").when(F.col("user_id") % 3 == 1, "anti")
    return table(spark, sf, "events").select("event_id", d.alias("direction"), S.alignment(role, d).alias("alignment"))


# ---- paths ----

PATHS_SQL = f"""WITH {ROBUST_SQL},
          h1 AS (SELECT o_custkey AS cust, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ord_rank FROM orders),
          h2 AS (SELECT l_orderkey AS ord, l_partkey AS part, l_extendedprice AS price, l_quantity AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS part_rank FROM lineitem),
          r AS (SELECT l_partkey AS part, l_suppkey AS supp, bool_or(l_returnflag = 'R') AS has_direct, count(*) AS evidence_count, sum(l_linenumber)::BIGINT AS pubmed_count, max(l_quantity) AS inference FROM lineitem GROUP BY 1, 2),
          h3 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY supp) AS supp_rank FROM r),
          j AS (SELECT cust, ord, part, supp, ord_rank, part_rank, supp_rank, has_direct, evidence_count, pubmed_count, price, quantity, inference FROM h1 JOIN h2 USING (ord) JOIN h3 USING (part) WHERE ord_rank <= 3 AND part_rank <= 2 AND supp_rank <= 2),
          c AS (SELECT *, 1 / (1 + exp(-(ln(1 + price) - price_median) / price_scale)) AS c_dose, quantity / 50 AS c_mapping, least(1.0, pubmed_count / 5) AS c_literature, 1 / (1 + exp(-(inference - quantity_median) / quantity_scale)) AS c_inference,
                 CASE WHEN has_direct THEN least(1.0, 0.65 + 0.35 * least(1.0, (evidence_count - 1) / 3 + 0.5 * least(1.0, pubmed_count / 5))) ELSE least(0.6, 0.1 + 0.45 * least(1.0, (evidence_count - 1) / 3 + 0.5 * least(1.0, pubmed_count / 5))) END AS c_support FROM j, st),
          q AS (SELECT *, round(least(1.0, 0.2 * c_dose + 0.15 * least(1.0, c_mapping) + 0.15 * c_literature + 0.2 * c_inference + 0.2 * c_support + 0.1 * 0.5), 6) AS quality FROM c),
          p AS (SELECT cust, ord, part, supp, ord_rank, part_rank, supp_rank, quality, has_direct, evidence_count, pubmed_count,
                 CASE WHEN has_direct THEN 'Preliminary Evidence' WHEN evidence_count >= 3 AND pubmed_count >= 3 AND quality >= 0.6 AND c_inference >= 0.65 THEN 'Moderate Evidence' WHEN (evidence_count >= 2 AND quality >= 0.4) OR quality >= 0.3 THEN 'Preliminary Evidence' ELSE 'Weak Evidence' END AS level
                FROM q WHERE quality >= 0.45)"""


def pathways(spark: SparkSession, sf: str) -> DataFrame:
    """Customer, order, part, supplier: the best few of each hop, scored."""
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    h1 = relational.top_k(orders, "cust", [F.desc("o_totalprice"), F.col("ord")], 3, "ord_rank").drop("o_totalprice")
    lines = li.select(F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), "l_linenumber")
    h2 = relational.top_k(lines, "ord", [F.desc("price"), F.col("l_linenumber"), F.col("part")], 2, "part_rank").drop("l_linenumber")
    edges = relational.evidence_rollup(li, [F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")], F.lit(None).cast("string"), F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_linenumber"))
    h3 = relational.top_k(edges, "part", [F.col("supp")], 2, "supp_rank")
    rows = paths.chain([(h1, "cust", "ord", 3), (h2, "ord", "part", 2), (h3, "part", "supp", 2)])
    rows = stats.with_row(rows, price_stats(li))
    none = F.array().cast("array<string>")
    parts = {
        "dose": S.logistic(S.log_amount(F.col("price")), F.col("price_median"), F.col("price_scale")),
        "mapping": S.clip01(F.col("quantity") / 50),
        "literature": S.clip01(F.col("pubmed_count") / 5),
        "inference": S.logistic(F.col("score"), F.col("quantity_median"), F.col("quantity_scale")),
        "support": S.support(F.col("has_direct"), none, F.col("evidence_count"), F.col("pubmed_count")),
        "direction": F.lit(0.5),
    }
    rows = rows.withColumn("quality", r6(S.weighted(parts))).withColumn("level", S.evidence_level(F.col("has_direct"), none, F.col("pubmed_count"), F.col("evidence_count"), F.col("quality"), parts["inference"]))
    return rows.filter("quality >= 0.45").select("cust", "ord", "part", "supp", "ord_rank", "part_rank", "supp_rank", "quality", "has_direct", "evidence_count", "pubmed_count", "level")


@query(PATHS_SQL + " SELECT cust, ord, part, supp, quality, has_direct, evidence_count, pubmed_count, level FROM p ORDER BY cust, ord_rank, part_rank, supp_rank LIMIT 6000")
def multi_hop_pathways(spark, sf):
    """The flagship: scored multi-hop paths, the first 6000 in order; the reports are about all of them."""
    ranks = ("ord_rank", "part_rank", "supp_rank")
    return pathways(spark, sf).orderBy("cust", *ranks).limit(6000).drop(*ranks)


@query(PATHS_SQL + """ SELECT count(*) AS total, count(DISTINCT cust) AS n_cust, count(DISTINCT part) AS n_part, count(DISTINCT supp) AS n_supp, round(avg(quality), 6) AS mean_quality, round(quantile_cont(quality, 0.5), 6) AS median_quality,
          round(quantile_cont(quality, 0.9), 6) AS p90_quality, count_if(quality >= 0.75)::BIGINT AS n_high, count_if(quality < 0.75)::BIGINT AS n_rest, count_if(has_direct)::BIGINT AS n_direct, round(avg(evidence_count), 6) AS mean_evidence_count, max(evidence_count)::DOUBLE AS max_evidence_count FROM p""")
def pathway_summary(spark, sf):
    """One row about all paths."""
    one = paths.summary(pathways(spark, sf), "quality", ["cust", "part", "supp"], direct="has_direct", averaged=["evidence_count"])
    return one.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes])


@query(PATHS_SQL + """ SELECT CASE WHEN quality >= 0.75 THEN 'high' WHEN quality >= 0.6 THEN 'moderate' ELSE 'low' END AS tier, cust, supp, quality FROM p""")
def tier_split(spark, sf):
    """Paths by tier of quality."""
    return pathways(spark, sf).select(S.tier(F.col("quality")).alias("tier"), "cust", "supp", "quality")


@query(PATHS_SQL + """ SELECT supp, count(*) AS paths, round(avg(quality), 6) AS mean_quality FROM p GROUP BY supp ORDER BY count(*) DESC, avg(quality) DESC, supp LIMIT 5""")
def top_contributors(spark, sf):
    """The five suppliers with most paths."""
    return paths.contributors(pathways(spark, sf), "supp", "quality").withColumn("mean_quality", r6(F.col("mean_quality")))


@query(PATHS_SQL + " SELECT level, count(*) AS n FROM p GROUP BY level")
def evidence_hist(spark, sf):
    """Paths by level of evidence."""
    return pathways(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


NODE_LIST = (("cust_node", "customer"), ("part_node", "part"), ("supp_node", "supplier"))
BEST_SQL = PATHS_SQL + ", t AS (SELECT 'C' || cust AS cust_node, 'P' || part AS part_node, 'S' || supp AS supp_node, quality FROM p ORDER BY quality DESC, cust, ord, part, supp LIMIT 50)"


def best_network(spark, sf):
    rows = pathways(spark, sf)
    named = rows.select("*", F.concat(F.lit("C"), "cust").alias("cust_node"), F.concat(F.lit("P"), "part").alias("part_node"), F.concat(F.lit("S"), "supp").alias("supp_node"))
    return paths.network(named, NODE_LIST, "quality", 50, [F.col(c) for c in ("cust", "ord", "part", "supp")])


@query(BEST_SQL + " SELECT node, kind, min(quality) AS quality FROM (SELECT cust_node AS node, 'customer' AS kind, quality FROM t UNION ALL SELECT part_node, 'part', quality FROM t UNION ALL SELECT supp_node, 'supplier', quality FROM t) GROUP BY node, kind")
def network_nodes(spark, sf):
    """Nodes of the fifty best paths."""
    return best_network(spark, sf)[0]


@query(BEST_SQL + " SELECT src, dst, min(quality) AS quality FROM (SELECT cust_node AS src, part_node AS dst, quality FROM t UNION ALL SELECT part_node, supp_node, quality FROM t) GROUP BY src, dst")
def network_edges(spark, sf):
    """Edges of the fifty best paths."""
    return best_network(spark, sf)[1]


@query("""SELECT 'C' || (o_custkey % 50) AS src, o_orderpriority AS dst, 3::BIGINT AS weight FROM orders GROUP BY 1, 2 UNION ALL
          SELECT o_orderpriority, o_orderstatus, greatest(max(o_custkey % 9), 1)::BIGINT FROM orders GROUP BY 1, 2""")
def compound_graph(spark, sf):
    """A two-step graph with fixed weights first and evidence second."""
    rows = table(spark, sf, "orders").withColumn("c", F.concat(F.lit("C"), (F.col("o_custkey") % 50))).withColumn("n", F.col("o_custkey") % 9)
    return paths.weighted_graph(rows, rows, "c", "o_orderpriority", "o_orderstatus", "n")


# ---- texts ----

#: Words, or beginnings of words, that stand for cues in the invented language of the documents.
CUE_WORDS = {"up": "[Tt]hat", "down": "[Ww]ith", "bind": "[Tt]his[a-z]", "neutral": "[Ff]rom", "direct": "[Ww]as"}
BEGINNINGS = ("up", "bind")
#: Spark looks around a word, which takes a tenth of the time of matching its neighbours; SQL's patterns cannot.
CUE_PATTERNS = {n: rf"(?<![A-Za-z0-9_]){w}" + ("" if n in BEGINNINGS else r"(?![A-Za-z0-9_])") for n, w in CUE_WORDS.items()}
SQL_PATTERNS = {n: rf"(^|[^A-Za-z0-9_]){w}" + ("" if n in BEGINNINGS else r"([^A-Za-z0-9_]|$)") for n, w in CUE_WORDS.items()}
LEXICON = ("THE", "OF", "AND", "DE", "ER", "EN", "IN", "LA", "CI", "TO", "WAS")

SENT_SQL = r"""WITH s0 AS (SELECT doc_id, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '([.?!])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: length(x) > 2) AS ss FROM documents),
          s AS (SELECT doc_id, (i - 1)::INTEGER AS idx, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0))"""
CUE_SQL = SENT_SQL + ", c AS (SELECT doc_id, idx, sentence, " + ", ".join(f"regexp_matches(sentence, '{p}') AS \"{n}\"" for n, p in SQL_PATTERNS.items()) + " FROM s)"


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.spread(table(spark, sf, "documents").select("doc_id", "text"))


def doc_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return mining.split_sentences(doc_texts(spark, sf), "doc_id", F.col("text"))


def cue_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return mining.flag_cues(doc_sentences(spark, sf), CUE_PATTERNS)


@query(SENT_SQL + " SELECT doc_id, idx, md5(sentence) AS digest, length(sentence) AS n FROM s")
def sentence_split(spark, sf):
    """Sentences of all documents."""
    return doc_sentences(spark, sf).select("doc_id", "idx", F.md5("sentence").alias("digest"), F.length("sentence").cast("bigint").alias("n"))


TERM_SQL = """, k AS (SELECT DISTINCT doc_id, idx, upper(token) AS term FROM (SELECT doc_id, idx, unnest(regexp_extract_all(sentence, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*')) AS token FROM s)
          WHERE regexp_matches(token, '^[A-Z]') AND upper(token) IN ('""" + "', '".join(LEXICON) + "'))"


def term_hits(sentences: DataFrame, *others: str) -> DataFrame:
    """(doc_id, idx, others, term): lexicon terms that begin with a capital; others are columns of the sentence."""
    lexicon = sentences.sparkSession.createDataFrame([(x, x) for x in LEXICON], "form string, term string")
    tokens = F.regexp_extract_all("sentence", F.lit(T.CAPITAL_LINKED), F.lit(0))
    keys = ["doc_id", "idx", *others]
    # a sentence is one row, so its terms are told apart within it; the lexicon has none with a hyphen
    forms = F.array_distinct(F.transform(tokens, lambda t: F.replace(F.upper(t), F.lit("-"), F.lit(""))))
    return mining.dictionary_hits(sentences, forms, lexicon, keys).select(*keys, "term")


@query(SENT_SQL + TERM_SQL + " SELECT doc_id, idx, term FROM k")
def dictionary_tag(spark, sf):
    """Lexicon terms in each sentence."""
    return term_hits(doc_sentences(spark, sf))


WORD_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_,:''-]*[\p{L}\p{M}\p{N}_]')"


@query(rf"""WITH b AS (SELECT {WORD_SQL} AS ws, item_id FROM benchmark), l AS (SELECT DISTINCT array_to_string(ws[i:i + k - 1], ' ') AS phrase, k AS size FROM (SELECT ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b, (VALUES (2), (3), (4)) t(k))),
          d AS (SELECT doc_id, {WORD_SQL} AS ws FROM documents), p AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (VALUES (2), (3), (4)) t(k)))
          SELECT doc_id, size, count(*) AS n, md5(string_agg(phrase, '|' ORDER BY encode(phrase))) AS digest FROM p JOIN l USING (phrase) GROUP BY doc_id, size""")
def lexicon_phrases(spark, sf):
    """Documents and the phrases of two to four words that they share with the benchmark, some ten thousand of them."""
    lower = table(spark, sf, "benchmark").select(T.phrase_words(F.col("text")).alias("ws"))
    lexicon = None
    for k in (2, 3, 4):
        starts = F.when(F.size("ws") >= k, F.sequence(F.lit(1), F.size("ws") - (k - 1)))
        run = lower.select("ws", F.explode(starts).alias("i")).select(F.array_join(F.slice("ws", F.col("i"), F.lit(k)), " ").alias("phrase"), F.lit(k).alias("size")).distinct()
        lexicon = run if lexicon is None else lexicon.unionByName(run)
    hits = phrases.phrase_hits(table(spark, sf, "documents"), ["doc_id"], F.col("text"), checkpointed(lexicon))
    g = hits.groupBy("doc_id", "size").agg(F.array_sort(F.collect_list("phrase")).alias("found"))
    return g.select("doc_id", "size", F.size("found").cast("bigint").alias("n"), F.md5(F.array_join("found", "|")).alias("digest"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), 'that|with|from') AS metabolic, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(THE|OF)([^A-Za-z0-9_]|$)') THEN 1.3 ELSE 1.0 END::DOUBLE AS factor FROM documents""")
def dictionary_support(spark, sf):
    """Documents with a keyword, and a factor for those that name a term as a whole word."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lexicon = spark.createDataFrame([("THE",), ("OF",)], "span string")
    spans = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("span"))
    named = relational.lookup_join(spans, lexicon, "span", "left_semi").select("doc_id").distinct().withColumn("hit", F.lit(True))
    keyword = F.lower(F.coalesce("text", F.lit(""))).rlike("that|with|from")
    return docs.join(named, "doc_id", "left").select("doc_id", keyword.alias("metabolic"), F.when(F.col("hit"), 1.3).otherwise(1.0).alias("factor"))


@query(CUE_SQL + """ SELECT doc_id, idx, up, down, bind, neutral, direct, CASE WHEN up AND NOT down THEN 'positive' WHEN down AND NOT up THEN 'negative' ELSE 'neutral' END AS polarity FROM c""")
def cue_flags(spark, sf):
    """Cue families and polarity of each sentence."""
    pol = T.polarity(F.col("sentence"), CUE_PATTERNS["up"], CUE_PATTERNS["down"])
    return cue_sentences(spark, sf).withColumn("polarity", pol).drop("sentence")


@query(CUE_SQL + """ SELECT doc_id, idx, min(CASE WHEN neutral THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
          coalesce(bool_or(direct) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), false) AS direct_near FROM c""")
def band_window(spark, sf):
    """First flagged sentence near each sentence."""
    rows = mining.band(cue_sentences(spark, sf).drop("sentence"), "doc_id", "neutral", 1)
    return mining.any_in_band(rows, "doc_id", "direct", 1, "direct_near").select("doc_id", "idx", "near", "direct_near")


VOTE_SQL = CUE_SQL + TERM_SQL + """, w AS (SELECT *, min(CASE WHEN neutral THEN idx END) OVER b AS near, coalesce(bool_or(direct) OVER b, false) AS dn FROM c WINDOW b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
          h AS (SELECT w.*, term, CASE WHEN near = idx THEN 1.5 ELSE 0.5 END * CASE WHEN dn THEN 1.3 ELSE 1.0 END AS base FROM w JOIN k USING (doc_id, idx) WHERE near IS NOT NULL),
          v AS (SELECT doc_id, term, idx, 'upregulation' AS kind, 0 AS no, 1.2 * base AS w FROM h WHERE up UNION ALL SELECT doc_id, term, idx, 'downregulation', 1, 1.2 * base FROM h WHERE down UNION ALL SELECT doc_id, term, idx, 'binding', 2, 0.8 * base FROM h WHERE bind),
          g AS (SELECT doc_id, term, kind, round(sum(w)::DOUBLE, 9) AS score, min(idx * 10 + no) AS first FROM v GROUP BY doc_id, term, kind),
          d AS (SELECT doc_id, term, count_if(dn) AS direct_hits FROM h GROUP BY doc_id, term),
          b AS (SELECT doc_id, term, kind, score, direct_hits, CASE WHEN direct_hits >= 2 OR (kind <> 'binding' AND score >= 2.8) THEN 'strong' WHEN score >= 1.6 THEN 'moderate' ELSE 'weak' END AS strength
                FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY score DESC, first) = 1) JOIN d USING (doc_id, term)),
          votes AS (SELECT doc_id, term, kind, score, direct_hits::BIGINT AS direct_hits, strength, CASE strength WHEN 'strong' THEN least(1.0, score / 4) WHEN 'moderate' THEN least(1.0, score / 3) ELSE 0.4 END AS confidence FROM b)"""


def banded(spark: SparkSession, sf: str) -> DataFrame:
    return mining.banded_sentences(doc_texts(spark, sf), "doc_id", F.col("text"), CUE_PATTERNS["neutral"], CUE_PATTERNS["direct"], 1)


def votes(spark: SparkSession, sf: str) -> DataFrame:
    s = mining.flag_cues(banded(spark, sf).filter("near is not null"), {n: CUE_PATTERNS[n] for n in ("up", "down", "bind")})
    return term_votes(term_hits(s, "near", "direct_near", "up", "down", "bind"))


def term_votes(hits: DataFrame) -> DataFrame:
    return mining.vote(hits, ["doc_id", "term"], cues={"upregulation": "up", "downregulation": "down", "binding": "bind"})


@query(VOTE_SQL + " SELECT doc_id, term, kind, round(score, 4) AS score, direct_hits, strength, round(confidence, 2) AS confidence FROM votes")
def cue_votes(spark, sf):
    """Winning kind of interaction of each document and term."""
    return votes(spark, sf).withColumn("score", F.round("score", 4)).withColumn("confidence", F.round("confidence", 2))


STOP = ("ning", "thing", "inging")
#: Words of at least four letters that end in -tion or -ing.
SUFFIXED = r"(?<![A-Za-z])[A-Za-z]*(?:[Tt][Ii][Oo][Nn]|[A-Za-z][Ii][Nn][Gg])(?![A-Za-z])"
SUFFIX_SQL = SENT_SQL + r""", tok AS (SELECT doc_id, idx, unnest(regexp_extract_all(sentence, '[A-Za-z]{4,}')) AS token FROM s),
          m0 AS (SELECT doc_id, idx, lower(token) AS mention, 0 AS prio, 'term' AS source FROM tok WHERE lower(token) IN ('that', 'nation', 'with') UNION ALL
                 SELECT doc_id, idx, lower(token), 1, 'suffix' FROM tok WHERE regexp_matches(lower(token), '(tion|ing)$')),
          m AS (SELECT doc_id, mention, min(prio) AS prio, min(idx) AS idx FROM m0 WHERE mention NOT IN ('ning', 'thing', 'inging') GROUP BY doc_id, mention)"""


def suffix_rows(sentences: DataFrame) -> DataFrame:
    """(doc_id, idx, mention, source) of terms and words with a telling suffix, without the stop list."""
    stop = sentences.sparkSession.createDataFrame([(x,) for x in STOP], "mention string")
    tok = sentences.select("doc_id", "idx", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("t")).select("doc_id", "idx", F.lower("t").alias("mention"))
    terms = tok.filter(F.col("mention").isin("that", "nation", "with")).withColumn("source", F.lit("term"))
    suffixes = tok.filter(F.col("mention").rlike("(tion|ing)$")).withColumn("source", F.lit("suffix"))
    return relational.lookup_join(terms.unionByName(suffixes), stop, "mention", "left_anti")


@query(SUFFIX_SQL + " SELECT doc_id, mention, CASE prio WHEN 0 THEN 'term' ELSE 'suffix' END AS source FROM m")
def suffix_mentions(spark, sf):
    """Mentions of each document, the first kind of evidence for each."""
    rows = suffix_rows(doc_sentences(spark, sf))
    kinds = [rows.filter(F.col("source") == k).select("doc_id", "mention", "source").distinct() for k in ("term", "suffix")]
    return relational.priority_union(*kinds, keys=["doc_id", "mention"])


CO_SQL = CUE_SQL + TERM_SQL + r""", pol AS (SELECT doc_id, idx, CASE WHEN up AND NOT down THEN 'positive' WHEN down AND NOT up THEN 'negative' ELSE 'neutral' END AS polarity FROM c),
          mm AS (SELECT DISTINCT doc_id, idx, lower(token) AS mention FROM (SELECT doc_id, idx, unnest(regexp_extract_all(sentence, '[A-Za-z]{4,}')) AS token FROM s) WHERE regexp_matches(lower(token), '(tion|ing)$') AND lower(token) NOT IN ('ning', 'thing', 'inging')),
          co0 AS (SELECT k.term, mm.mention, count(DISTINCT k.doc_id) AS evidence_count, array_to_string(list_sort(list(DISTINCT k.doc_id::VARCHAR))[1:3], ',') AS docs, count_if(polarity = 'positive')::BIGINT AS n_positive, count_if(polarity = 'negative')::BIGINT AS n_negative
                 FROM k JOIN pol USING (doc_id, idx) JOIN mm USING (doc_id, idx) GROUP BY k.term, mm.mention),
          co AS (SELECT *, CASE WHEN n_positive > n_negative THEN 'positive' WHEN n_negative > n_positive THEN 'negative' ELSE 'neutral' END AS direction,
                        CASE WHEN n_positive > n_negative THEN 'risk_factor' WHEN n_negative > n_positive THEN 'protective' ELSE 'associated' END AS relationship FROM co0)"""


def suffixed(sentence: str) -> Column:
    """Distinct mentions by suffix in a sentence."""
    words = F.transform(F.regexp_extract_all(sentence, F.lit(SUFFIXED), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP)))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    s = mining.flag_cues(doc_sentences(spark, sf), {n: CUE_PATTERNS[n] for n in ("up", "down")})
    return term_links(term_hits(s.withColumn("mentions", suffixed("sentence")), "up", "down", "mentions"))


def term_links(hits: DataFrame) -> DataFrame:
    # an outer explode, since an inner one would look for mentions once more beforehand, to drop rows without
    pairs = hits.select("doc_id", "term", T.one_sided(F.col("up"), F.col("down")).alias("polarity"), F.explode_outer("mentions").alias("mention"))
    return mining.links(pairs.filter("mention IS NOT NULL"), "doc_id", "term", "mention")


@query(CO_SQL + " SELECT * FROM co")
def co_mention_polarity(spark, sf):
    """Terms and mentions in one sentence, with the direction of their link."""
    return relations(spark, sf).withColumn("docs", F.array_join("docs", ","))


COMPOSE_SQL = VOTE_SQL + CO_SQL[len(CUE_SQL + TERM_SQL) :] + """, mk AS (SELECT term, kind, sum(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS wt, max(round(confidence, 3)) AS conf FROM votes GROUP BY term, kind),
          mi AS (SELECT term, arg_max(kind, (wt, kind)) AS main, bool_or(kind = 'upregulation') AND bool_or(kind = 'downregulation') AS conflicting, max(conf) AS conf FROM mk GROUP BY term),
          fx AS (SELECT term, mention, main, relationship, evidence_count, conf, CASE WHEN direction = 'neutral' THEN 'uncertain' WHEN relationship = 'associated' THEN 'association_only' WHEN conflicting THEN 'context_specific'
                 WHEN main = 'upregulation' THEN CASE relationship WHEN 'risk_factor' THEN 'potentially_harmful' ELSE 'potentially_beneficial' END WHEN main = 'downregulation' THEN CASE relationship WHEN 'risk_factor' THEN 'potentially_beneficial' ELSE 'potentially_harmful' END ELSE 'uncertain' END AS effect FROM mi JOIN co USING (term))"""


@query(COMPOSE_SQL + """ SELECT term, mention, main, relationship, effect, 'compose(' || main || ',' || relationship || ') -> ' || effect AS rule,
          round(CASE WHEN effect IN ('context_specific', 'association_only') THEN round((conf + least(1.0, evidence_count / 5)) / 2, 3) * 0.8 ELSE (conf + least(1.0, evidence_count / 5)) / 2 END, 2) AS confidence FROM fx""")
def compose_effects(spark, sf):
    """Effects composed of the main interaction of a term and its links to mentions."""
    s = mining.flag_cues(banded(spark, sf), {n: CUE_PATTERNS[n] for n in ("up", "down", "bind")}).withColumn("mentions", suffixed("sentence"))
    # what votes and links are made of is worked out once, and stored without the texts
    hits = checkpointed(term_hits(s, "near", "direct_near", "up", "down", "bind", "mentions"))
    rows = mining.compose(term_votes(hits), term_links(hits), ["term"], "term", "mention")
    return rows.select("term", "mention", "main", "relationship", "effect", "rule", F.round("path_confidence", 2).alias("confidence"))


@query(COMPOSE_SQL + """, sn AS (SELECT doc_id, term, min(idx) AS idx FROM k GROUP BY doc_id, term), st AS (SELECT sn.doc_id, sn.term, CASE WHEN length(sentence) > 160 THEN substr(sentence, 1, 160) || '...' ELSE sentence END AS snippet FROM sn JOIN s USING (doc_id, idx)),
          tg AS (SELECT term, array_to_string(list_sort(list(kind || ':' || n)), ' | ') AS tags FROM (SELECT term, kind, count(*) AS n FROM votes GROUP BY term, kind) GROUP BY term)
          SELECT st.term, st.doc_id, md5(snippet) AS snippet, tags FROM st JOIN tg USING (term) WHERE (st.term, st.doc_id) IN (SELECT (term, doc_id) FROM votes)""")
def flat_evidence(spark, sf):
    """Evidence rows: first sentence of each term in a document, cut to a snippet, with counted kinds."""
    v = votes(spark, sf)
    s = doc_sentences(spark, sf)
    first = relational.best_per_key(term_hits(s), ["doc_id", "term"], [F.col("idx")]).join(s, ["doc_id", "idx"])
    tags = v.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), " | ").alias("tags"))
    rows = first.join(v.select("doc_id", "term"), ["doc_id", "term"], "left_semi").join(tags, "term")
    return rows.select("term", "doc_id", F.md5(T.clip_label(F.col("sentence"), 160, dots=True)).alias("snippet"), "tags")


@query("""WITH l AS (SELECT doc_id, 0 AS list_no, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE lower(text) LIKE '%the%' AND (lower(text) LIKE '%wasthe%' OR lower(text) LIKE '%thation%') UNION ALL
          SELECT doc_id, 1, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%inging%' UNION ALL
          SELECT doc_id, 2, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%erest%')
          SELECT doc_id, arg_min(list_no, (list_no, pos))::INTEGER AS list_no, arg_min(pos, (list_no, pos))::INTEGER AS pos FROM l WHERE pos <= 50 GROUP BY doc_id""")
def corpus_search(spark, sf):
    """Documents found by classes of terms, at most fifty a class, each where it comes first."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t")).filter(F.contains("t", F.lit("the")))
    lists = []
    for words in (("wasthe", "thation"), ("inging",), ("erest",)):
        found = docs.filter(T.contains_any([F.col("t")], words)).orderBy("doc_id").limit(50)
        lists.append(relational.top_k(found.withColumn("one", F.lit(1)), "one", [F.col("doc_id")], 50, "pos").select("doc_id", "pos"))
    return relational.ordered_union(lists, "doc_id", "pos")


@query(r"""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([CAST(l_quantity::INTEGER AS VARCHAR) || ' mg', CAST(l_linenumber AS VARCHAR) || ' g/day'])), ';') AS doses, CAST(l_linenumber AS VARCHAR) || ' weeks' AS times FROM lineitem""")
def dose_time_mentions(spark, sf):
    """Amounts and durations found in texts made of facts."""
    text = F.concat(F.lit("given "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mg, then "), F.col("l_linenumber").cast("string"), F.lit(" g/day for "), F.col("l_linenumber").cast("string"), F.lit(" weeks, "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mg"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.dose_mentions(text), ";").alias("doses"), F.array_join(T.time_mentions(text), ";").alias("times"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y') || '-12-31' WHEN 3 THEN strftime(o_orderdate, '%Y-%m') || '-01' ELSE strftime(o_orderdate, '%Y') || '-01-01' END AS d FROM orders""")
def partial_dates(spark, sf):
    """Dates from parts that may be missing, named or out of range."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    month = F.when(k == 1, F.date_format(d, "MMM")).when(k == 2, "13").when(k == 3, F.date_format(d, "M"))
    day = F.when(k == 1, F.date_format(d, "d")).when(k == 2, "40")
    return table(spark, sf, "orders").select("o_orderkey", T.partial_date(F.when(k != 0, F.date_format(d, "yyyy")), month, day).alias("d"))


@query("""WITH h AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ['Mice', 'Humans', 'Mice'] WHEN 'AUTOMOBILE' THEN ['Cells'] WHEN 'MACHINERY' THEN ['Rats', 'Cell Line'] ELSE ['Zebrafish', 'Dogs'] END AS hs FROM customer)
          SELECT c_custkey, CASE hs[1] WHEN 'Mice' THEN 'Human' WHEN 'Cells' THEN 'unspecified' WHEN 'Rats' THEN 'Rat' ELSE 'Zebrafish' END AS primary_species,
                 CASE hs[1] WHEN 'Mice' THEN 'Mouse,Human' WHEN 'Cells' THEN '' WHEN 'Rats' THEN 'Rat,Cellular' ELSE 'Zebrafish,Dog' END AS tags FROM h""")
def species_infer(spark, sf):
    """Species from headings that follow from the market segment."""
    seg = F.col("c_mktsegment")
    heads = lambda *x: F.array(*map(F.lit, x))
    hs = F.when(seg == "BUILDING", heads("Mice", "Humans", "Mice")).when(seg == "AUTOMOBILE", heads("Cells")).when(seg == "MACHINERY", heads("Rats", "Cell Line")).otherwise(heads("Zebrafish", "Dogs"))
    tags = T.species_tags(hs)
    return table(spark, sf, "customer").select("c_custkey", T.primary_species(tags).alias("primary_species"), F.array_join(tags, ",").alias("tags"))


@query("""SELECT 'event_type' AS "column", count(*) AS rows, count_if(event_type IS NULL)::BIGINT AS nulls, count_if(event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL)::BIGINT AS non_numeric FROM events UNION ALL
          SELECT 'value', count(*), count_if(value IS NULL)::BIGINT, 0::BIGINT FROM events UNION ALL SELECT 'props', count(*), count_if(props IS NULL)::BIGINT, count_if(props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL)::BIGINT FROM events""")
def profile_table(spark, sf):
    """Counts of each column: rows, nulls, values that are no numbers."""
    return stats.profile(table(spark, sf, "events").select("event_type", "value", "props")).drop("distinct")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, value NULLS FIRST LIMIT 10")
def top_values(spark, sf):
    """The ten most frequent values of a column."""
    return stats.top_values(table(spark, sf, "events"), "event_type")
