"""Sources, sinks and whole plans as queries: given tables are written in the formats that the plans read, and read back through the operators.

Files go to a folder of their own below the one that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph import lexicons as L
from evigraph import queries as evidence
from evigraph.checkpoint import checkpoint_folder, checkpointed
from evigraph.functions import scoring as S
from evigraph.functions import text as T
from evigraph.operators import mining, relational, stats, summaries
from evigraph.plans import etl, literature, pathways
from evigraph.sources import articles, store
from evigraph.sources import tables as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def r6(c):
    return F.round(c, 6)


# ---- stores, samples, counts ----

FIRST_SQL = "o_custkey AS key, o_orderdate AS saved_at, '{\"order\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS payload"
SECOND_SQL = "o_custkey AS key, o_orderdate AS saved_at, '{\"order\":\"n' || o_orderkey || '\",\"who\":{\"id\":' || (o_custkey % 7) || '},\"tags\":[\"' || o_orderpriority || '\"]}' AS payload"
STORE_SQL = f"""w AS (SELECT 1 AS write_no, {FIRST_SQL} FROM orders UNION ALL SELECT 2, {SECOND_SQL} FROM orders WHERE o_orderstatus = 'F'),
          s AS (SELECT key, saved_at, payload::JSON AS j FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY write_no DESC, saved_at DESC, payload DESC) = 1)"""


def order_store(spark: SparkSession, sf: str, compacted: bool = False) -> str:
    """A store of customers' orders, written twice, with payloads of two shapes."""
    name, orders = f"records_{uuid.uuid4().hex}", table(spark, sf, "orders")
    store.create_store(spark, name, scratch(spark, "store"), "bigint", buckets=16)
    order, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    first = F.concat(F.lit('{"order":'), order, F.lit(',"status":"'), status, F.lit('"}'))
    second = F.concat(F.lit('{"order":"n'), order, F.lit('","who":{"id":'), (F.col("o_custkey") % 7).cast("string"), F.lit('},"tags":["'), "o_orderpriority", F.lit('"]}'))
    store.upsert(orders, name, F.col("o_custkey"), first, F.col("o_orderdate"))
    store.upsert(orders.filter(status == "F"), name, F.col("o_custkey"), second, F.col("o_orderdate"))
    if compacted:
        store.compact(spark, name, scratch(spark, "store"))
    return name


@query(f"""WITH {STORE_SQL} SELECT key, saved_at, try_cast(j->>'$.order' AS BIGINT) AS order_no, j->>'$.status' AS status, try_cast(j->>'$.who.id' AS BIGINT) AS who, j->>'$.tags[0]' AS tag FROM s""")
def upsert_store(spark, sf):
    """The last record of each key after two rounds of upserts and a compaction, its fields read by typed paths."""
    rows = store.latest(spark, order_store(spark, sf, compacted=True))
    fields = {"order_no": ("$.order", "bigint"), "status": ("$.status", "string"), "who": ("$.who.id", "bigint"), "tag": ("$.tags[0]", "string")}
    return rows.select("key", "saved_at", *[store.field(*f).alias(n) for n, f in fields.items()])


@query(f"""WITH {STORE_SQL} SELECT c_custkey AS key, s.key IS NOT NULL AS found FROM customer LEFT JOIN s ON s.key = c_custkey AND saved_at >= TIMESTAMP '1997-01-01'""")
def store_lookup(spark, sf):
    """Requested keys with a fresh record in the store, and those without."""
    requested = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    have, lack = store.lookup(requested, order_store(spark, sf), "1997-01-01")
    return have.select("key", F.lit(True).alias("found")).unionByName(lack.select("key", F.lit(False).alias("found")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, md5('42:{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}') AS h FROM lineitem) ORDER BY h LIMIT 5000""")
def row_sample(spark, sf):
    """A seeded sample of exactly 5000 rows."""
    return IO.sample_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 5000)


@query("""SELECT 'kept' AS kind, event_type AS name, count(*) AS n FROM events WHERE value >= 10 GROUP BY event_type UNION ALL SELECT 'count', 'rows', count(*) FROM events
          UNION ALL SELECT 'count', 'dropped', count(*) FROM events WHERE NOT coalesce(value >= 10, false) UNION ALL SELECT 'count', 'no_value', count(*) FROM events WHERE value IS NULL UNION ALL SELECT 'count', 'errors', count(*) FROM events WHERE event_type = 'error'""")
def counted_write(spark, sf):
    """Rows that a filter lets through, written and read back, and the counts of the same job: all rows, dropped ones, and two kinds."""
    out = scratch(spark, "counted")
    counts = IO.write_counted(table(spark, sf, "events"), out, F.col("value") >= 10, {"no_value": F.col("value").isNull(), "errors": F.col("event_type") == "error"})
    kept = spark.read.parquet(out).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), "name", "n")
    return kept.unionByName(spark.createDataFrame([("count", k, v) for k, v in counts.items()], "kind string, name string, n bigint"))


@query("""WITH m AS (SELECT unnest([{'name': 'value', 'v': value}, {'name': 'user_id', 'v': user_id::DOUBLE}], recursive := true) FROM events)
          SELECT name, count(*) AS n_rows, count(*) - count(v) AS nulls, min(v) AS least, max(v) AS greatest, round(sum(v), 2) AS total, true AS distinct_near, true AS quantiles_near FROM m GROUP BY name""")
def merged_summaries(spark, sf):
    """Days of events summarised apart, one of them stored wrongly first and replaced, then merged; sketches are held against the exact figures."""
    e, path = table(spark, sf, "events"), scratch(spark, "summaries")
    day, measures, points = F.to_date("ts"), {"value": F.col("value"), "user_id": F.col("user_id")}, [0.05, 0.25, 0.5, 0.75, 0.95]
    early = F.dayofmonth("ts") <= 10
    summaries.store_parts(summaries.summarize(e.filter(early).withColumn("value", F.when(F.dayofmonth("ts") == 10, 0.0).otherwise(F.col("value"))), day, measures), path)
    summaries.store_parts(summaries.summarize(e.filter(~early | (F.dayofmonth("ts") == 10)), day, measures), path)
    m = checkpointed(summaries.merge(summaries.load_parts(spark, path)).select("*", summaries.quantiles(points).alias("q"), summaries.distinct().alias("d")))
    long = e.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in measures.items()])))
    seen = long.join(F.broadcast(m.select("name", "q")), "name")  # two rows
    ranks = [F.struct(F.count_if(F.col("v") < F.col("q")[i]).alias("below"), F.count_if(F.col("v") <= F.col("q")[i]).alias("upto")) for i in range(len(points))]
    exact = seen.groupBy("name").agg(F.count("v").alias("n"), F.count_distinct("v").alias("true_d"), *[r.alias(f"r{i}") for i, r in enumerate(ranks)])
    off = 2 * summaries.RANK_ERROR
    near = [(F.col(f"r{i}.below") <= (p + off) * F.col("n")) & (F.col(f"r{i}.upto") >= (p - off) * F.col("n")) for i, p in enumerate(points)]
    near_d = F.abs(F.col("d") - F.col("true_d")) <= 2 * summaries.DISTINCT_ERROR * F.col("true_d")
    return m.join(exact, "name").select("name", F.col("rows").alias("n_rows"), "nulls", "least", "greatest", F.round("total", 2).alias("total"), near_d.alias("distinct_near"), reduce(and_, near).alias("quantiles_near"))


@query("""SELECT c_nationkey::VARCHAR AS part, c_mktsegment AS item, count(*) AS n FROM customer GROUP BY ALL""")
def frequent_by_part(spark, sf):
    """The five most frequent values of each part (there are five in all), read from stored summaries; two writes of half the customers each, by part and half."""
    c, path = table(spark, sf, "customer"), scratch(spark, "frequent")
    for half in (0, 1):
        rows = c.filter(F.col("c_custkey") % 2 == half)
        summaries.store_parts(summaries.summarize(rows, F.concat_ws("-", "c_nationkey", F.lit(half)), values={"segment": F.col("c_mktsegment")}), path)
    parts = summaries.load_parts(spark, path).withColumn("nation", F.split_part("part", F.lit("-"), F.lit(1)))
    return summaries.merge(parts, "nation").select(F.col("nation").alias("part"), F.inline(summaries.frequent(5))).select("part", "item", F.col("count").alias("n"))


CODE_SQL = "'C' || (o_custkey % 90 + 10) || '.' || (o_orderkey % 97 + 100) || '.' || (o_orderkey % 7 + 100)"


@query(f"""WITH c AS (SELECT o_orderkey, {CODE_SQL} || '|D' || (o_custkey % 50 + 10) || '.' || (o_orderkey % 89 + 100) AS codes FROM orders),
          b AS (SELECT DISTINCT branch FROM (SELECT 'C' || (c_custkey % 45 + 10) || '.' || (c_custkey % 97 + 100) || CASE WHEN c_custkey % 3 = 0 THEN '.' || (c_custkey % 7 + 100) ELSE '' END AS branch FROM customer UNION ALL SELECT 'D' || (c_custkey % 7 + 10) FROM customer))
          SELECT o_orderkey, codes FROM c WHERE EXISTS (SELECT 1 FROM b WHERE '|' || codes || '|' LIKE '%|' || branch || '|%' OR '|' || codes LIKE '%|' || branch || '.%')""")
def code_branches(spark, sf):
    """Rows one of whose codes lies in one of very many branches."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    number = lambda x, m, d: (F.col(x) % m + d).cast("string")
    codes = F.concat(F.lit("C"), number("o_custkey", 90, 10), F.lit("."), number("o_orderkey", 97, 100), F.lit("."), number("o_orderkey", 7, 100), F.lit("|D"), number("o_custkey", 50, 10), F.lit("."), number("o_orderkey", 89, 100))
    deep = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("."), number("c_custkey", 7, 100))).otherwise("")
    branches = c.select(F.concat(F.lit("C"), number("c_custkey", 45, 10), F.lit("."), number("c_custkey", 97, 100), deep).alias("branch")).unionByName(c.select(F.concat(F.lit("D"), number("c_custkey", 7, 10)).alias("branch")))
    return relational.in_branches(o.select("o_orderkey", codes.alias("codes")), "codes", branches)


@query("""SELECT n, name FROM (SELECT (row_number() OVER (ORDER BY name))::INTEGER AS n, name FROM (SELECT DISTINCT lower(p_type) || ' ' || p_name AS name FROM part)) WHERE n <= 300""")
def first_names(spark, sf):
    """The first three hundred distinct names in order."""
    rows = table(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("name")).distinct().orderBy("name").limit(300)
    return rows.agg(F.array_sort(F.collect_list("name")).alias("names")).select(F.posexplode("names").alias("n", "name")).select((F.col("n") + 1).alias("n"), "name")


# ---- sources ----


@query("""SELECT p_partkey AS part_key, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN p_size END::BIGINT AS size, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_brand END, 'none') AS brand, 'x' AS origin FROM part WHERE p_size % 7 <> 0""")
def csv_conform(spark, sf):
    """A delimited file with untidy names, other names, bad numbers, nulls, an absent column and keys that are missing."""
    p = table(spark, sf, "part")
    size = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    key = F.when(F.col("p_size") % 7 != 0, F.col("p_partkey"))
    raw = p.select(key.alias("﻿Part-Key"), F.col("p_name").alias("Full Name"), size.alias("SIZE_mm"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("Brand"), F.lit("?").alias("Other"))
    path = scratch(spark, "csv")
    raw.write.option("quote", '"').option("escape", '"').csv(path, header=True)
    spec = IO.Spec(("part_key", "name", "size", "brand"), {"full_name": "name"}, {"size": "size_"}, ("part_key", "name"), {"part_key": "bigint", "size": "bigint"}, {"brand": "none", "origin": "x"}, ("part_key",))
    rows = IO.conform(IO.split_rejects(IO.read_delimited(spark, path))[0], spec)
    return rows.select("part_key", "name", "size", "brand", "origin")


@query("""SELECT c_custkey::VARCHAR AS "Key", c_name AS "Name", c_mktsegment AS "Segment", (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0)::BIGINT AS rejected FROM customer WHERE c_custkey % 4 <> 0""")
def commented_rejects(spark, sf):
    """A tab-delimited file with its header in a comment, comments among the rows, a column without values, and rows of another length."""
    c = table(spark, sf, "customer")
    row = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.lit(""))
    lines = F.when(F.col("c_custkey") % 4 == 0, F.array(F.concat(row, F.lit("\textra\tfields")))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("# a remark"), row)).otherwise(F.array(row))
    path = scratch(spark, "tsv")
    head = spark.createDataFrame([(None, -2, "# made from a table"), (None, -1, "# Key\tName\tSegment\tNotes")], "key bigint, place int, value string")
    body = head.unionByName(c.select(F.col("c_custkey").alias("key"), F.posexplode(lines).alias("place", "value")))
    body.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("value").write.text(path, compression="gzip")
    fit, rejects = IO.split_rejects(IO.read_commented(spark, path, ("Key", "Name", "Segment", "Notes")))
    n = rejects.agg(F.count(F.lit(1)).alias("rejected"))
    return stats.with_row(IO.drop_empty_columns(fit), n)


@query("""SELECT o_orderpriority AS "ORDER PRIORITY", CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS "Status Code" FROM orders WHERE o_orderpriority IS NOT NULL""")
def matching_columns(spark, sf):
    """Columns picked by words in their names, without rows that are empty in all of them."""
    o = table(spark, sf, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("ORDER PRIORITY"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("Status Code"))
    path = scratch(spark, "wide")
    blank = rows.select("o_orderkey", F.lit(None).cast("string").alias("ORDER PRIORITY"), F.lit(None).cast("string").alias("Status Code"))
    rows.unionByName(blank).write.csv(path, sep="\t", header=True)
    return IO.read_matching_columns(spark, path, ("PRIORITY", "STATUS"))


@query("SELECT p_name, p_brand FROM part")
def present_columns(spark, sf):
    """The wanted columns that a table has."""
    return IO.read_present(spark, f"{sf}/part.parquet", ("p_name", "p_colour", "p_brand"))


@query("SELECT 'nation.parquet' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region.parquet', count(*) FROM region")
def table_catalog(spark, sf):
    """Rows of the tables that exist; the absent one is left out."""
    found = IO.load_catalog(spark, sf, ("nation.parquet", "continent.parquet", "region.parquet"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in found.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT n_nationkey, n_name FROM nation")
def largest_of_files(spark, sf):
    """The largest of several files of one kind."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    top = scratch(spark, "files")
    n.filter("n_nationkey < 2").coalesce(1).write.parquet(f"{top}/a")
    n.coalesce(1).write.parquet(f"{top}/b")
    return spark.read.parquet(IO.largest_file(spark, top, "*.parquet"))


@query("""SELECT o_orderkey::VARCHAR AS pmid, 'On <b>' || o_orderpriority || '</b> & more' AS title, 'AIM: to ship. ' || CASE WHEN o_orderkey % 2 = 0 THEN 'RESULT: ' ELSE '' END || 'it was ' || o_orderstatus AS abstract,
                 CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') || '-01' WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pub_date,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'Humans,Mice' ELSE 'Rats' END AS headings, CASE WHEN o_orderkey % 2 = 0 THEN 'Human' ELSE 'Rat' END AS primary_species, 'order;' || o_orderstatus AS keywords FROM orders""")
def article_xml(spark, sf):
    """Articles in XML, with marked-up titles, labelled abstracts, partial dates and headings."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    label = F.when(k % 2 == 0, F.lit(' Label="RESULT"')).otherwise("")
    date = F.when(k % 3 == 0, F.format_string("<PubDate><Year>%s</Year><Month>%s</Month></PubDate>", F.date_format(d, "yyyy"), F.date_format(d, "MMM")))
    date = date.when(k % 3 == 1, F.format_string("<PubDate><MedlineDate>%s Spring</MedlineDate></PubDate>", F.date_format(d, "yyyy")))
    date = date.otherwise(F.format_string("<PubDate><Year>1900</Year></PubDate><ArticleDate><Year>%s</Year><Month>%s</Month><Day>%s</Day></ArticleDate>", F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")))
    heads = F.when(k % 2 == 0, '<DescriptorName UI="D1" MajorTopicYN="N">Humans</DescriptorName><DescriptorName UI="D2" MajorTopicYN="Y">Mice</DescriptorName>').otherwise('<DescriptorName UI="D3" MajorTopicYN="N">Rats</DescriptorName>')
    xml = F.concat(
        F.lit("<PubmedArticle><PMID>"), k.cast("string"), F.lit("</PMID><Journal><Title>J</Title></Journal><ArticleTitle>On &lt;b&gt;<i>"), "o_orderpriority", F.lit("</i>&lt;/b&gt; &amp; more</ArticleTitle><Abstract>"),
        F.lit('<AbstractText Label="AIM">to <sub>ship</sub>.</AbstractText><AbstractText'), label, F.lit(">it was "), "o_orderstatus", F.lit("</AbstractText></Abstract>"), date, F.lit("<MeshHeadingList>"), heads,
        F.lit("</MeshHeadingList><Keyword>order</Keyword><Keyword>"), "o_orderstatus", F.lit("</Keyword></PubmedArticle>"),
    )
    path = scratch(spark, "xml")
    table(spark, sf, "orders").select(xml.alias("value")).write.text(path)
    rows = articles.parse_articles(articles.read_articles(spark, path))
    return rows.select("pmid", "title", "abstract", "pub_date", F.array_join("mesh_terms", ",").alias("headings"), "primary_species", F.array_join("keywords", ";").alias("keywords"))


@query(r"""WITH g AS (SELECT upper(p_brand) AS symbol, p_partkey, unnest([p_brand] || string_split(p_type || '–' || p_size % 3 || '|' || p_name, '|')) AS name FROM part),
          f AS (SELECT symbol, p_partkey, regexp_replace(replace(upper(name), '–', '-'), '[^A-Z0-9-]', '', 'g') AS x FROM g),
          u AS (SELECT symbol, p_partkey, x AS form FROM f UNION ALL SELECT symbol, p_partkey, replace(x, '-', '') FROM f)
          SELECT form, arg_min(symbol, (p_partkey, symbol)) AS symbol FROM u WHERE form <> '' GROUP BY form""")
def alias_lexicon(spark, sf):
    """Forms of symbols and their aliases, each owned by the first row that has it."""
    p = table(spark, sf, "part").withColumn("aliases", F.concat("p_type", F.lit("–"), (F.col("p_size") % 3).cast("string"), F.lit("|"), "p_name"))
    return mining.alias_index(p, "p_brand", ["aliases"], "p_partkey")


@query("""WITH own AS (SELECT DISTINCT lower(p_type) AS name, 'OWN:' || p_type AS id FROM part WHERE p_size % 2 = 0), built AS (SELECT DISTINCT lower(p_type) AS name, 'BUILT:' || p_type AS id FROM part)
          SELECT * FROM own UNION ALL SELECT * FROM built WHERE name NOT IN (SELECT name FROM own)""")
def override_lexicon(spark, sf):
    """Own entries of a CSV file before the built-in ones."""
    p = table(spark, sf, "part")
    path = scratch(spark, "own")
    p.filter("p_size % 2 = 0").select(F.col("p_type").alias("Name"), F.concat(F.lit("OWN:"), "p_type").alias("ID")).distinct().write.csv(path, header=True)
    own = IO.normalize_names(IO.read_delimited(spark, path).drop(IO.CORRUPT)).select(T.normalize_key(F.col("name")).alias("name"), "id")
    built = p.select(T.normalize_key(F.col("p_type")).alias("name"), F.concat(F.lit("BUILT:"), "p_type").alias("id")).distinct()
    return relational.priority_union(own, built, keys=["name"], order=[F.col("id")])


# ---- sinks ----


@query("SELECT o_orderpriority AS match_method, o_totalprice AS fuzzy_score, o_orderkey FROM orders")
def sorted_csv(spark, sf):
    """A table written as CSV in order over all its files, and read back."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("match_method"), F.col("o_totalprice").alias("fuzzy_score"), "o_orderkey")
    path = scratch(spark, "sorted")
    IO.write_sorted_csv(o, path, F.asc("match_method"), F.desc("fuzzy_score"), F.col("o_orderkey"))
    rows = IO.split_rejects(IO.read_delimited(spark, path))[0]
    return rows.select("match_method", F.col("fuzzy_score").cast("double").alias("fuzzy_score"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"))


@query("""SELECT l_suppkey, count(*) AS n, count(*) AS in_order, sum(l_linenumber)::BIGINT AS line_numbers, 1::BIGINT AS documents FROM lineitem GROUP BY l_suppkey""")
def streamed_documents(spark, sf):
    """One JSON document a supplier, written line by line over all files, and read back: its items, those that stand after the one before, and openings."""
    li, path = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), scratch(spark, "documents")
    IO.write_documents(li, path, "l_suppkey", "l_orderkey", "l_linenumber")
    items = IO.read_documents(spark, path, "l_suppkey bigint, l_orderkey bigint, l_linenumber bigint")
    at = F.col("_at")
    before = F.lag(F.struct("l_orderkey", "l_linenumber")).over(Window.partitionBy("l_suppkey").orderBy(at))
    rows = items.select("*", F.coalesce(F.struct("l_orderkey", "l_linenumber") >= before, F.lit(True)).alias("ok")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("in_order"), F.sum("l_linenumber").alias("line_numbers"))
    opened = spark.read.text(path).select(F.regexp_extract("value", r'^\{"l_suppkey":(\d+),"items":\[$', 1).alias("k")).filter("k <> ''").groupBy(F.col("k").cast("bigint").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("documents"))
    return rows.join(opened, "l_suppkey", "left")


@query("SELECT n_regionkey, len(list(n_name))::INTEGER AS n, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def nested_json(spark, sf):
    """Rows of a key as one JSON object, and read back."""
    path = scratch(spark, "json")
    nations = table(spark, sf, "nation").select("n_regionkey", "n_name")
    IO.write_nested_json(nations, path, "n_regionkey")
    rows = spark.read.schema(f"n_regionkey {dict(nations.dtypes)['n_regionkey']}, items array<struct<n_name: string>>").json(path)
    return rows.select("n_regionkey", F.size("items").alias("n"), F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT l_orderkey, max(l_shipdate) AS saved_at, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def record_store(spark, sf):
    """The last record of each key of a store that was written in two steps."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("saved_at"))
    # of the lines of a day the last counts
    li = li.groupBy("l_orderkey", "saved_at").agg(F.max("l_linenumber").alias("l_linenumber"))
    path = scratch(spark, "store")
    for part in (0, 1):
        IO.append_records(li.filter(F.col("l_linenumber") % 2 == part), path)
    return IO.latest_records(spark, path, "l_orderkey").select("l_orderkey", "saved_at", "l_linenumber")


# ---- the nutrition plan ----

NUTRIENTS = ("Calcium, Ca", "Iron, Fe", "Vitamin B-6", "Protein", "Zinc, Zn", "Ash", "Niacin", "Water")
FOODS_SQL = f"""fr AS (SELECT CASE WHEN l_suppkey % 19 = 0 THEN 'Energy Shot ' ELSE '' END || p_name || ' ' || p_type || ' ' || p_brand || ' of a long label to be cut' AS description,
          (['{"', '".join(NUTRIENTS)}'])[(l_orderkey + l_linenumber) % {len(NUTRIENTS)} + 1] AS name, l_quantity / 20 AS amount, l_orderkey * 10 + l_linenumber AS fdc_id FROM lineitem JOIN part ON l_partkey = p_partkey),
          dv(nutrient, dv_mg) AS (VALUES {", ".join(f"('{n}', {a * L.UNIT_TO_MG[u]!r}::DOUBLE)" for n, (u, a) in L.DAILY_VALUES.items() if n in NUTRIENTS)})"""


def food_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of nutrients in foods, made of facts and parts."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = li.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand"), "l_partkey")
    name = F.element_at(F.array(*map(F.lit, NUTRIENTS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(NUTRIENTS) + 1).cast("int"))
    description = F.concat(F.when(F.col("l_suppkey") % 19 == 0, "Energy Shot ").otherwise(""), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" of a long label to be cut"))
    return rows.select(description.alias("description"), name.alias("name"), (F.col("l_quantity") / 20).alias("amount_mg_per_100g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fdc_id"), F.lit(0).alias("nutrient_id"))


@query(f"""WITH {FOODS_SQL}, e AS (SELECT substr(description, 1, 40) AS food, name AS nutrient, amount, dv_mg, coalesce(amount / dv_mg, 0) AS ratio, fdc_id FROM fr LEFT JOIN dv ON name = nutrient),
          k AS (SELECT * FROM e WHERE (amount >= 0.5 OR (ratio >= 0.01 AND amount >= 0.001)) AND NOT regexp_matches(lower(food), 'energy shot'))
          SELECT food, nutrient, round(amount, 6) AS nutrient_amount, dv_mg, round(ratio, 6) AS dv_ratio, rank AS nutrient_rank
          FROM (SELECT *, (row_number() OVER (PARTITION BY food ORDER BY ratio DESC, amount DESC, nutrient, fdc_id))::INTEGER AS rank FROM k) WHERE rank <= 5""")
def food_edges(spark, sf):
    """Nutrients that matter in each food, the five best."""
    rows = pathways.food_edges(food_rows(spark, sf))
    return rows.withColumn("nutrient_amount", r6(F.col("nutrient_amount"))).withColumn("dv_ratio", r6(F.col("dv_ratio")))


ACTIONS = ("increases^expression", "decreases^activity", "affects^binding", "increases^a|decreases^b")
CHEM_SQL = f"""cg0 AS (SELECT 'MESH:D' || p_size % 20 AS ChemicalID, replace(p_brand, '#', '') AS GeneSymbol, (['{"', '".join(ACTIONS)}'])[p_partkey % 4 + 1] AS InteractionActions,
          CASE WHEN p_partkey % 3 = 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS Organism, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE replace(p_name, ' ', '|') || '|' || p_type END AS PublicationIDs FROM part),
          cg AS (SELECT DISTINCT ChemicalID, GeneSymbol, InteractionActions, CASE WHEN PublicationIDs = '' THEN 0 ELSE len(string_split(PublicationIDs, '|')) END::INTEGER AS ref_count FROM cg0 WHERE Organism = 'Homo sapiens')"""


def chem_genes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    refs = F.when(k % 11 == 0, "").otherwise(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("|")), F.lit("|"), "p_type"))
    raw = p.select(F.concat(F.lit("MESH:D"), (F.col("p_size") % 20).cast("string")).alias("ChemicalID"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")).alias("GeneSymbol"), F.element_at(F.array(*map(F.lit, ACTIONS)), (k % 4 + 1).cast("int")).alias("InteractionActions"), F.when(k % 3 == 0, "Mus musculus").otherwise("Homo sapiens").alias("Organism"), refs.alias("PublicationIDs"))
    return etl.clean_chem_genes(raw)


@query(f"WITH {CHEM_SQL} SELECT * FROM cg")
def clean_chem_genes(spark, sf):
    """Distinct human interactions with their numbers of references."""
    return chem_genes(spark, sf)


MAP_SQL = f"""m0 AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'Vitamin ' || p_type ELSE p_name END AS nutrient, 'd' || p_size % 25 AS cid, CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'override_cid' END AS method, CASE p_size % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 85.0 + p_size % 10 END::DOUBLE AS score FROM part),
          m1 AS (SELECT nutrient, upper(cid) AS chemical_id, 1 / (1 + exp(-((0.55 * CASE method WHEN 'exact' THEN 0.95 WHEN 'fuzzy' THEN 0.8 ELSE 0.55 END + 0.25 * coalesce(score, 0) / 100
                 + 0.2 * CASE WHEN regexp_matches(lower(nutrient), '{L.either(w for ws in L.NUTRIENT_WORDS.values() for w in ws)}') THEN 1 ELSE 0 END) - 0.6) / 0.15)) AS confidence FROM m0 WHERE upper(cid) IN (SELECT substr(ChemicalID, 6) FROM cg)),
          vm AS (SELECT nutrient, chemical_id, confidence FROM m1 QUALIFY row_number() OVER (PARTITION BY nutrient ORDER BY confidence DESC, chemical_id) = 1)"""


def chemical_map(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    n = F.col("p_size")
    method = F.when(n % 3 == 0, "exact").when(n % 3 == 1, "fuzzy").otherwise("override_cid")
    score = F.when(n % 3 == 0, 100.0).when(n % 3 == 1, 85.0 + n % 10)
    return p.select(F.when(n % 4 == 0, F.concat(F.lit("Vitamin "), "p_type")).otherwise(F.col("p_name")).alias("fdc_nutrient_name"), F.concat(F.lit("d"), (n % 25).cast("string")).alias("ChemicalID"), method.alias("match_method"), score.alias("fuzzy_score")).distinct()


@query(f"WITH {CHEM_SQL}, {MAP_SQL} SELECT nutrient, chemical_id, round(confidence, 6) AS confidence FROM vm")
def validated_map(spark, sf):
    """The surest chemical with genes of each nutrient."""
    return pathways.validated_map(chemical_map(spark, sf), chem_genes(spark, sf)).withColumn("confidence", r6(F.col("confidence")))


@query(f"""WITH {CHEM_SQL}, {MAP_SQL}, th AS (SELECT greatest(1.0, round_even(quantile_cont(ref_count, 0.75), 0)) AS least FROM cg),
          tr AS (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS gene FROM part WHERE p_size % 6 = 1),
          j AS (SELECT nutrient, GeneSymbol AS gene, chemical_id, ref_count::DOUBLE AS ref_count, confidence, InteractionActions AS actions, CASE WHEN upper(GeneSymbol) IN (SELECT gene FROM tr) THEN 1.3 ELSE 1.0 END::DOUBLE AS gwas_factor,
                CASE WHEN InteractionActions LIKE '%increase%' AND InteractionActions LIKE '%decrease%' THEN 'mixed' WHEN InteractionActions LIKE '%increase%' THEN 'up' WHEN InteractionActions LIKE '%decrease%' THEN 'down' ELSE 'unknown' END AS gene_direction
                FROM cg JOIN vm ON substr(ChemicalID, 6) = chemical_id, th WHERE confidence >= 0.5 AND ref_count >= least)
          SELECT nutrient, gene, chemical_id, ref_count, round(confidence, 6) AS confidence, gene_direction, gwas_factor, rank AS gene_rank
          FROM (SELECT *, (row_number() OVER (PARTITION BY nutrient ORDER BY confidence DESC, ref_count DESC, gwas_factor DESC, gene, chemical_id, actions))::INTEGER AS rank FROM j) WHERE rank <= 3""")
def gene_edges(spark, sf):
    """The three surest genes of each nutrient, those of metabolic traits weighed up."""
    cg = chem_genes(spark, sf)
    least = stats.data_thresholds(cg, "ref_count", cg, "ref_count").select("min_literature")
    traits = table(spark, sf, "part").select(F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.when(F.col("p_size") % 2 == 0, "-AS1").otherwise(" - X9")).alias("MAPPED_GENE"), F.when(F.col("p_size") % 6 == 1, "Type 2 diabetes").otherwise("Height").alias("DISEASE/TRAIT"))
    rows = pathways.gene_edges(pathways.validated_map(chemical_map(spark, sf), cg), cg, traits, least)
    return rows.select("nutrient", "gene", "chemical_id", "ref_count", r6(F.col("confidence")).alias("confidence"), "gene_direction", "gwas_factor", "gene_rank")


CODES = ("therapeutic", "marker/mechanism", "", " ")
GD_SQL = f"""gd AS (SELECT DISTINCT replace(p_brand, '#', '') AS GeneSymbol, 'Disease ' || s_nationkey || ' of ' || l_linestatus AS DiseaseName, 'MESH:C' || s_nationkey AS DiseaseID, (['{"', '".join(CODES)}'])[l_linenumber % 4 + 1] AS code, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS score,
          CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN l_suppkey::VARCHAR || '| |7' ELSE '9' END AS pubs FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
          gc AS (SELECT GeneSymbol, DiseaseName, DiseaseID, code AS direct_evidence, trim(code) <> '' AS has_direct_ev, coalesce(score, 0) AS inference_score, pubs AS pubmed_ids, CASE WHEN pubs = '' THEN 0 WHEN pubs = '9' THEN 1 ELSE 2 END::INTEGER AS pubmed_count FROM gd)"""


def gene_diseases(spark: SparkSession, sf: str) -> DataFrame:
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    rows = li.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    n = F.col("l_linenumber")
    pubs = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.col("l_suppkey").cast("string"), F.lit("| |7"))).otherwise("9")
    raw = rows.select(
        F.replace(F.col("p_brand"), F.lit("#"), F.lit("")).alias("GeneSymbol"), F.concat(F.lit("Disease "), F.col("s_nationkey").cast("string"), F.lit(" of "), "l_linestatus").alias("DiseaseName"), F.concat(F.lit("MESH:C"), F.col("s_nationkey").cast("string")).alias("DiseaseID"),
        F.element_at(F.array(*map(F.lit, CODES)), (n % 4 + 1).cast("int")).alias("DirectEvidence"), F.when(n == 5, "bad").otherwise(F.col("l_quantity").cast("string")).alias("InferenceScore"), pubs.alias("PubMedIDs"),
    )
    return etl.clean_gene_diseases(raw)


@query(f"WITH {GD_SQL} SELECT * FROM gc")
def clean_gene_diseases(spark, sf):
    """Distinct links of genes and diseases with flags, scores and article counts."""
    return gene_diseases(spark, sf)


@query(f"""WITH {GD_SQL}, th AS (SELECT greatest(2.5, quantile_cont(inference_score, 0.8)) AS least FROM gc),
          k AS (SELECT * FROM gc, th WHERE inference_score >= least AND DiseaseID IN (SELECT 'MESH:C' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)),
          e AS (SELECT GeneSymbol AS gene, DiseaseID AS disease_id, DiseaseName AS disease, bool_or(has_direct_ev) AS has_direct, coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(direct_evidence), '')) FILTER (trim(direct_evidence) <> '')), '|'), '') AS codes,
                max(inference_score) AS inference_score, count(*) AS evidence_count, sum(pubmed_count)::BIGINT AS pubmed_count FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 2 OR sum(pubmed_count) >= 2)
          SELECT *, substr(disease, 1, 40) AS disease_label FROM (SELECT *, (row_number() OVER (PARTITION BY gene ORDER BY disease_id NULLS LAST, disease))::INTEGER AS disease_rank FROM e) WHERE disease_rank <= 3""")
def disease_edges(spark, sf):
    """The first three diseases of each gene, of a subset and with enough evidence."""
    gd = gene_diseases(spark, sf)
    least = stats.data_thresholds(gd, "pubmed_count", gd, "inference_score").select("min_inference")
    subset = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("MESH:C"), F.col("n_nationkey").cast("string")).alias("DiseaseID"))
    return pathways.disease_edges(gd, subset, least).drop("min_inference")


@query(r"""SELECT DISTINCT 'D' || p_partkey AS DiseaseID, p_name AS DiseaseName, CASE p_size % 4 WHEN 0 THEN 'C18.452' WHEN 1 THEN 'C01|C19.1' WHEN 2 THEN 'XC18' ELSE 'C17' END AS TreeNumbers FROM part WHERE p_size % 4 < 2""")
def metabolic_branches(spark, sf):
    """Diseases with a code of two branches."""
    n = F.col("p_size") % 4
    code = F.when(n == 0, "C18.452").when(n == 1, "C01|C19.1").when(n == 2, "XC18").otherwise("C17")
    return etl.metabolic_diseases(table(spark, sf, "part").select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("DiseaseID"), F.col("p_name").alias("DiseaseName"), code.alias("TreeNumbers")))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'pro' WHEN 1 THEN 'anti' END AS role, CASE n_nationkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS alignment FROM nation")
def role_alignment(spark, sf):
    """Roles of genes looked up by upper-case symbol, and how an upward change agrees with them."""
    roles = L.gene_roles(spark).select(F.col("gene").alias("role_gene"), "role")
    k = F.col("n_nationkey") % 4
    n = table(spark, sf, "nation").withColumn("gene", F.when(k == 0, "tnf").when(k == 1, "Sod2").otherwise(F.col("n_name")))
    rows = relational.lookup_join(n, roles, F.upper("gene") == F.col("role_gene"))
    return rows.select("n_nationkey", "role", S.alignment(F.col("role"), F.lit("up")).alias("alignment"))


# ---- the literature plan ----

#: Words of every cue family, and some of none; texts are made of them.
CUE_WORDS = (
    "upregulates", "increased", "knock-down", "reduces", "binding", "receptor", "modulates", "altering", "directly", "targets", "polymorphisms", "genotype", "mRNA", "expression", "sugar-sweetened", "drinkers",
    "promotes", "risk factor", "attenuated", "protective", "no significant effect", "unchanged", "treated with", "mg/kg", "lecithin-cholesterol acyltransferase", "coffee", "cups per day", "table", "window", "nothing",
)
FAMILIES = tuple(L.CUES)
CUE_SQL = "', '".join(CUE_WORDS)
CUE_TEXT_SQL = f"SELECT l_orderkey, l_linenumber, (['{CUE_SQL}'])[(l_partkey % {len(CUE_WORDS)}) + 1] || ' and ' || (['{CUE_SQL}'])[(l_suppkey % {len(CUE_WORDS)}) + 1] || ', ' || (['{CUE_SQL}'])[(l_orderkey % {len(CUE_WORDS)}) + 1] AS t FROM lineitem"


@query(f"WITH x AS ({CUE_TEXT_SQL}) SELECT l_orderkey, l_linenumber, " + ", ".join(f"regexp_matches(t, '{'|'.join(L.CUES[f])}', 'i') AS \"{f}\"" for f in FAMILIES) + f""", CASE WHEN regexp_matches(t, '{'|'.join(L.CUES['positive'])}', 'i') AND NOT regexp_matches(t, '{'|'.join(L.CUES['negative'])}', 'i') THEN 'positive'
          WHEN regexp_matches(t, '{'|'.join(L.CUES['negative'])}', 'i') AND NOT regexp_matches(t, '{'|'.join(L.CUES['positive'])}', 'i') THEN 'negative' ELSE 'neutral' END AS polarity FROM x""")
def cue_families(spark, sf):
    """All families of cues, and polarity, in sentences made of their words."""
    word = lambda c: F.element_at(F.array(*map(F.lit, CUE_WORDS)), (F.col(c) % len(CUE_WORDS) + 1).cast("int"))
    t = F.concat(word("l_partkey"), F.lit(" and "), word("l_suppkey"), F.lit(", "), word("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("sentence"))
    return mining.flag_cues(rows, {f: L.cue(f) for f in FAMILIES}).withColumn("polarity", T.polarity(F.col("sentence"))).drop("sentence")


@query("""SELECT c_custkey, upper(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' (Mouse)' END AS label, regexp_replace(regexp_replace(lower(c_name || ' + ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token,
                 CASE c_custkey % 3 WHEN 0 THEN 'BRCA1,HLA-B,T2' WHEN 1 THEN 'BRCA1' ELSE '' END AS genes, CASE c_custkey % 3 WHEN 0 THEN 'BRCA1,HLA-B,T2' WHEN 1 THEN 'BRCA1,OF' ELSE '' END AS capitals, 'marker/mechanism,therapeutic' AS codes FROM customer""")
def gene_text_functions(spark, sf):
    """Labels with species, tokens, gene-like words, capital words and codes of evidence."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "BRCA1 and HLA-B in T2 cells of x").when(k % 3 == 1, "BRCA1 OF x").otherwise("nothing here")
    label = T.species_label(F.upper("c_mktsegment"), F.when(k % 4 == 0, "unspecified").otherwise("Mouse"), k % 2 == 0)
    codes = F.transform(T.list_tokens(F.lit(" Marker/Mechanism |therapeutic")), lambda c: F.lower(T.strip(c)))
    return table(spark, sf, "customer").select(
        "c_custkey", label.alias("label"), T.token(F.concat("c_name", F.lit(" + "), "c_mktsegment")).alias("token"), F.array_join(F.array_sort(T.gene_tokens(text)), ",").alias("genes"), F.array_join(T.upper_tokens(text), ",").alias("capitals"), F.array_join(codes, ",").alias("codes"),
    )


COMPOUNDS = ("coffee", "caffeine", "lecithin")
SENTENCES = (
    "She drank coffee daily, treated with care.", "Caffeine intake reduced TNF.", "The lecithin-cholesterol acyltransferase was fed.", "Lecithins were administered.", "Decaf coffee consumption per day.", "Nothing of note.", "1,3,7-trimethylxanthine dose.", "Coffees are not consumed.",
)
#: Of each sentence: the compound that it names with an intervention.
NAMED = ((0, "coffee"), (1, "caffeine"), (3, "lecithin"), (4, "coffee"), (6, "caffeine"))


@query(f"WITH n(i, compound) AS (VALUES {', '.join(map(str, NAMED))}) SELECT compound, c_custkey AS pmid, 0::INTEGER AS idx FROM customer JOIN n ON c_custkey % {len(SENTENCES)} = i")
def compound_mentions(spark, sf):
    """Sentences that name a compound by any of its names, no enzyme of like name, and an intervention."""
    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("c_custkey") % len(SENTENCES) + 1).cast("int"))
    papers = table(spark, sf, "customer").select(F.col("c_custkey").alias("pmid"), said.alias("title"), F.lit("").alias("abstract"))
    return literature.compound_sentences(literature.article_sentences(papers), L.compound_lexicon(spark, COMPOUNDS))


#: Titles of articles; those of the first two tell of a compound, a gene and a disease, the third is ruled out.
TITLES = ("Coffee intake increased TNF gene expression in colitis.", "Caffeine dose directly inhibits ADORA2A in hepatitis.", "Coffee intake of drinkers and SSB gene activity increased.", "Nothing was measured in arthritis.")
#: What follows from them: compound, gene, kind, score, direct hits, strength, confidence; disease, direction, relationship, effect.
TOLD = (
    (0, "coffee", "TNF", "upregulation", 1.8, 0, "moderate", 0.6, "colitis", "positive", "risk_factor", "potentially_harmful"),
    (1, "caffeine", "ADORA2A", "downregulation", 2.34, 1, "moderate", 0.78, "hepatitis", "negative", "protective", "potentially_harmful"),
)
TOLD_SQL = f"""told(i, compound, gene, kind, score, hits, strength, confidence, disease, direction, relationship, effect) AS (VALUES {", ".join(map(str, TOLD))}),
          pa AS (SELECT c_custkey::VARCHAR AS pmid, told.* FROM customer JOIN told ON c_custkey % {len(TITLES)} = i),
          ev AS (SELECT compound, gene, any_value(kind) AS kind, any_value(confidence) AS confidence, disease, any_value(direction) AS direction, any_value(relationship) AS relationship, any_value(effect) AS effect, count(*) AS n, list_sort(list(pmid))[1:3] AS docs FROM pa GROUP BY compound, gene, disease),
          ef AS (SELECT *, 'compose(' || kind || ',' || relationship || ') [Human] -> ' || effect AS rule, round((confidence + least(1.0, n / 5)) / 2, 3) AS path_confidence FROM ev)"""


def papers(spark: SparkSession, sf: str) -> DataFrame:
    customers = IO.spread(table(spark, sf, "customer"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("c_custkey") % len(TITLES) + 1).cast("int"))
    none, human = F.array().cast("array<string>"), F.array(F.lit("Humans"))
    detail = F.array().cast("array<struct<name: string, ui: string, is_major: boolean>>")
    tags = T.species_tags(human)
    return customers.select(
        F.col("c_custkey").cast("string").alias("pmid"), title.alias("title"), F.lit("").alias("abstract"), human.alias("mesh_terms"), detail.alias("mesh_detail"), F.array(F.lit("Review")).alias("publication_types"), none.alias("keywords"),
        T.primary_species(tags).alias("primary_species"), tags.alias("species_tags"),
    )


def result(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return literature.analyze(papers(spark, sf), L.compound_lexicon(spark, COMPOUNDS))


@query(f"WITH {TOLD_SQL} SELECT compound, pmid, gene, gene || ' (Human)' AS gene_display, kind, score::DOUBLE AS score, hits::BIGINT AS direct_hits, strength, confidence::DOUBLE AS confidence FROM pa")
def literature_interactions(spark, sf):
    """Interactions of compounds and genes in articles, by votes of their sentences."""
    found = result(spark, sf)[0]
    return found.select("compound", "pmid", "gene", "gene_display", "kind", "score", "direct_hits", "strength", "confidence")


@query(f"WITH {TOLD_SQL} SELECT gene, disease, n AS evidence_count, array_to_string(docs, ',') AS docs, direction, relationship, 'Human' AS species FROM ev")
def literature_links(spark, sf):
    """Genes of interactions and diseases that share a sentence."""
    return result(spark, sf)[1].select("gene", "disease", "evidence_count", F.array_join("docs", ",").alias("docs"), "direction", "relationship", "species")


@query(f"WITH {TOLD_SQL} SELECT compound, gene, disease, kind AS main, relationship, effect, rule, path_confidence::DOUBLE AS path_confidence FROM ef")
def literature_effects(spark, sf):
    """Effects of compounds on diseases."""
    return result(spark, sf)[2].select("compound", "gene", "disease", "main", "relationship", "effect", "rule", "path_confidence")


@query(f"""WITH {TOLD_SQL}, t(i, said) AS (VALUES {", ".join(map(str, enumerate(x.lower() for x in TITLES)))}), e AS (SELECT ef.*, said FROM ef JOIN told USING (compound) JOIN t USING (i)),
          r AS (SELECT compound AS "Compound", gene || ' (Human)' AS "Gene (species)", kind || ' (moderate)' AS "Drug->Gene", relationship || ' (' || direction || ')' AS "Gene->Disease", effect AS "Drug->Disease (predicted)", rule AS "Rule", path_confidence::DOUBLE AS "Confidence",
          'Human' AS "Species", 'pub:Review' AS "Study context", array_to_string([d || ': ' || said FOR d IN docs], ' || ') AS "Evidence snippets", kind || ':' || n AS "Evidence tags" FROM e) SELECT * FROM r""")
def evidence_csv(spark, sf):
    """The evidence of all effects as CSV in eleven columns, beside the complete result as JSON, read back."""
    out = scratch(spark, "result")
    literature.write_results(*result(spark, sf), papers(spark, sf), out)
    rows = IO.split_rejects(IO.read_delimited(spark, f"{out}/evidence_csv"))[0]
    return rows.withColumn("Confidence", F.col("Confidence").cast("double"))


@query(f"""WITH {TOLD_SQL} SELECT (SELECT count(*) FROM pa) AS interactions, (SELECT count(DISTINCT gene) FROM pa) AS genes, (SELECT round(avg(confidence), 3)::DOUBLE FROM pa) AS mean_confidence, (SELECT count(*) FROM ef) AS effects, (SELECT count(DISTINCT disease) FROM ef) AS diseases,
          (SELECT array_to_string(list_sort(list(kind || ':' || n)), ',') FROM (SELECT kind, count(*) AS n FROM pa GROUP BY kind)) AS kinds, 'Review:' || (SELECT count(*) FROM pa) AS publication_types""")
def literature_stats(spark, sf):
    """Totals and counters of a result."""
    found, _, effects = result(spark, sf)
    one = literature.result_stats(found, effects, papers(spark, sf))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return one.select("interactions", "genes", "mean_confidence", "effects", "diseases", text("by_kind").alias("kinds"), text("by_publication_type").alias("publication_types"))


@query("SELECT p_partkey, p_size % 3 <> 0 AS found FROM part")
def phrase_hits(spark, sf):
    """Whether a text has a phrase as whole words, whatever the case and the white space between them."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("The "), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("  \n"))), F.when(F.col("p_size") % 3 == 0, "s").otherwise(", too"))
    return p.select("p_partkey", F.regexp_like(text, T.phrase_pattern(F.col("p_name"))).alias("found"))


@query("""SELECT 'p_name' AS "column", count(*) AS rows, count_if(p_name IS NULL)::BIGINT AS nulls, count(DISTINCT p_name) AS "distinct", count_if(p_name IS NOT NULL AND try_cast(p_name AS DOUBLE) IS NULL)::BIGINT AS non_numeric FROM part UNION ALL
          SELECT 'p_size', count(*), count_if(p_size IS NULL)::BIGINT, count(DISTINCT p_size), 0::BIGINT FROM part""")
def column_profile(spark, sf):
    """Counts of columns, distinct values among them."""
    return stats.profile(table(spark, sf, "part").select("p_name", "p_size"))


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL ORDER BY value LIMIT 20")
def bad_values(spark, sf):
    """The first twenty distinct values of a column that are no numbers."""
    rows = table(spark, sf, "events").filter(F.col("event_type").isNotNull() & F.col("event_type").try_cast("double").isNull())
    return stats.column_samples(rows, "event_type")


@query(evidence.PATHS_SQL + """ SELECT 'level' AS kind, level AS key, count(*) AS n FROM p GROUP BY level UNION ALL SELECT 'tier', CASE WHEN quality >= 0.75 THEN 'high' WHEN quality >= 0.6 THEN 'moderate' ELSE 'low' END, count(*) FROM p GROUP BY 2
          UNION ALL SELECT 'total', 'paths', count(*) FROM p UNION ALL SELECT 'best', cust || '-' || ord || '-' || part || '-' || supp, 1 FROM (SELECT * FROM p ORDER BY quality DESC, cust::VARCHAR, part::VARCHAR, supp::VARCHAR, ord::VARCHAR LIMIT 8)""")
def exported_report(spark, sf):
    """What the export of scored paths writes: levels, tiers, the summary row and the eight best paths, read back."""
    names = {"food": "cust", "nutrient": "part", "gene": "supp", "disease": "ord"}
    rows = evidence.pathways(spark, sf).select(*[F.col(v).cast("string").alias(k) for k, v in names.items()], F.col("quality").alias("pathway_quality_score"), F.col("level").alias("evidence_level"), F.col("has_direct").alias("has_direct_evidence"), "evidence_count", "pubmed_count")
    out = scratch(spark, "report")
    pathways.export(rows, out)
    levels = spark.read.parquet(f"{out}/levels").select(F.lit("level").alias("kind"), F.col("evidence_level").alias("key"), "n")
    tiers = spark.read.parquet(f"{out}/pathways").groupBy(F.col("tier").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tier").alias("kind"), "key", "n")
    total = IO.split_rejects(IO.read_delimited(spark, f"{out}/summary_csv"))[0].select(F.lit("total").alias("kind"), F.lit("paths").alias("key"), F.col("total").cast("bigint").alias("n"))
    best = spark.read.parquet(f"{out}/top_paths").select(F.lit("best").alias("kind"), F.concat_ws("-", "food", "disease", "nutrient", "gene").alias("key"), F.lit(1).cast("bigint").alias("n"))
    return levels.unionByName(tiers).unionByName(total).unionByName(best)
