"""Work that grows no faster than its input."""

import pytest
from pyspark.sql import functions as F

from evigraph import io_queries
from evigraph.operators import relational
from evigraph.sources import articles


def test_split_by_store_deals_out_records(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k int")
        store = spark.createDataFrame([(1, 5), (1, 6), (1, 1), (2, 1), (None, 9)], "k int, at int")
        have, lack = relational.split_by_store(asked, store, "k", "at", F.lit(5))
        assert sorted(r.k for r in have.collect()) == [1, 1]
        assert sorted((r.k for r in lack.collect()), key=str) == [2, 3, None]
        for df in (have, lack):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # not merged again by their bytes, and one row a key
            assert "REPARTITION_BY_NUM" in plan and "HashAggregate(keys=[k" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_customers_are_dealt_out(spark):
    assert io_queries.papers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_article_is_walked_once():
    class Counted:
        """An element whose walks are counted."""

        def __init__(self, node):
            self.node, self.walks, self.tag = node, 0, node.tag

        def iter(self, *tag):
            self.walks += 1
            return self.node.iter(*tag)

        def __getattr__(self, name):
            assert name not in ("find", "iterfind"), "a walk of its own"
            return getattr(self.node, name)

    xml = '<PubmedArticle><PMID>1</PMID><PMID>2</PMID><Title>no</Title><Journal><Title>J</Title></Journal><ArticleTitle>A<i>b</i>c</ArticleTitle><Abstract><AbstractText Label="X">u<b>v</b></AbstractText><AbstractText/></Abstract><AbstractText>no</AbstractText><PubDate><Year>1999</Year><MedlineDate>m</MedlineDate></PubDate><DescriptorName UI="" MajorTopicYN="Y">H</DescriptorName><Keyword/><Keyword>k</Keyword></PubmedArticle>'
    root = Counted(articles.ET.fromstring(xml))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(articles.ET, "fromstring", lambda _: root)
        got = articles.record_of(xml)
    assert root.walks == 1
    assert (got["pmid"], got["title"], got["journal"], got["medline_date"], got["keywords"]) == ("1", "Abc", "J", "m", ["k"])
    assert got["parts"] == [{"label": "X", "body": "uv"}, {"label": "", "body": ""}]
    assert got["pub_date"] == {"year": "1999", "month": "", "day": ""} and got["article_date"] is None
    assert got["mesh_detail"] == [{"name": "H", "ui": None, "is_major": True}]
