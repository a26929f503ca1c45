"""Documents of any size written line by line."""

import glob
import json

from pyspark.sql import functions as F

from evigraph.sources import articles
from evigraph.sources import tables as IO


def parsed(path):
    text, out, decoder = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))).strip(), [], json.JSONDecoder()
    while text:
        one, end = decoder.raw_decode(text)
        out.append(one)
        text = text[end:].strip()
    return out


def test_stream_of_documents(spark, tmp_path):
    # one key holds most rows and passes through several files
    d = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit('a"}],['), F.col("id") % 40)).alias("k"), "id", F.lit("line\nfeed }").alias("t"))
    path = str(tmp_path / "d")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        IO.write_documents(d, path, "k", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = parsed(path)
    want = {}
    for r in d.collect():
        want.setdefault(r.k, []).append(r.id)
    assert len(docs) == len(want) and {x["k"]: [i["id"] for i in x["items"]] for x in docs} == {k: sorted(v) for k, v in want.items()}
    assert all(i["t"] == "line\nfeed }" and i.get("k") == x["k"] for x in docs for i in x["items"])
    assert len(glob.glob(f"{path}/part-*")) > 1
    back = IO.read_documents(spark, path, "k string, id bigint, t string")
    assert sorted(map(repr, back.drop("_at").collect())) == sorted(map(repr, d.collect()))
    hot = [r.id for r in back.filter("k = 'hot'").orderBy("_at").collect()]
    assert hot == sorted(hot)


def test_no_rows_and_one(spark, tmp_path):
    d = spark.createDataFrame([(None, 1)], "k string, id int")
    IO.write_documents(d.limit(0), str(tmp_path / "none"), "k", "id")
    IO.write_documents(d, str(tmp_path / "one"), "k", "id", name='the "items"')
    assert parsed(tmp_path / "none") == [] and parsed(tmp_path / "one") == [{"k": None, 'the "items"': [{"id": 1}]}]


def test_articles_are_parsed_once_and_rejects_are_told(spark):
    good = '<PubmedArticle><PMID> 7 </PMID><ArticleTitle>On <i>x &lt; y</i> &amp; z</ArticleTitle><Abstract><AbstractText Label="AIM">a <b>b</b></AbstractText><AbstractText/></Abstract><OtherAbstract><AbstractText>no</AbstractText></OtherAbstract><Keyword/></PubmedArticle>'
    rows = spark.createDataFrame([(good, 1), ("<PubmedArticle><PMID>8</PubmedArticle>", 2), (None, 3), ("<PubmedArticle/>", 4), (good, 5)], "xml string, pmid int")
    got = articles.parse_articles(rows).collect()
    assert [(r.pmid, r.title, r.abstract, r.pub_date, r.keywords, r.mesh_detail) for r in got] == [("7", "On x < y & z", "AIM: a b ", "", [], [])] * 2
    assert [r.xml for r in articles.malformed(rows).collect()] == ["<PubmedArticle><PMID>8</PubmedArticle>"]
    assert articles.parse_articles(rows.limit(0)).count() == 0
