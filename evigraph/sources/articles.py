"""Article XML to rows: records are cut by Spark's text source, each is parsed once in Arrow batches, and its fields are finished by column functions."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from evigraph.functions import text as T
from evigraph.workers import ship

ship(__name__)

TEXT = pa.string()
DATE = pa.struct({"year": TEXT, "month": TEXT, "day": TEXT})
HEADING = pa.struct({"name": TEXT, "ui": TEXT, "is_major": pa.bool_()})
ARROW_RECORD = pa.struct({
    "pmid": TEXT, "title": TEXT, "journal": TEXT, "parts": pa.list_(pa.struct({"label": TEXT, "body": TEXT})), "article_date": DATE, "pub_date": DATE, "medline_date": TEXT,
    "mesh_detail": pa.list_(HEADING), "publication_types": pa.list_(TEXT), "keywords": pa.list_(TEXT),
})
RECORD = from_arrow_type(ARROW_RECORD)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(xml): one article a row."""
    return spark.read.option("lineSep", "</PubmedArticle>").text(path).filter(F.contains("value", F.lit("<PubmedArticle"))).select(
        F.concat(F.regexp_extract("value", r"(?s)(<PubmedArticle[ >].*)$", 1), F.lit("</PubmedArticle>")).alias("xml")
    )


def _text(node: ET.Element | None) -> str:
    """All text of an element, marked-up parts included; nothing for none."""
    if node is None or not len(node):
        return "" if node is None else node.text or ""
    return "".join(node.itertext())


def record_of(xml: str) -> dict | None:
    """What an article's XML says, as ARROW_RECORD; None where it is no XML."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None

    def date(node: ET.Element | None) -> dict | None:
        return None if node is None else {k: _text(node.find(k.title())) for k in ("year", "month", "day")}

    # the tree is walked once
    tags: dict[str, list[ET.Element]] = {}
    for node in root.iter():
        tags.setdefault(node.tag, []).append(node)

    def every(tag: str) -> list[ET.Element]:
        return tags.get(tag, [])

    def below(parent: str, child: str) -> list[ET.Element]:
        return [c for p in every(parent) if p is not root for c in p if c.tag == child]

    def first(nodes: list[ET.Element]) -> ET.Element | None:
        return nodes[0] if nodes else None

    published = first(every("PubDate"))
    return {
        "pmid": _text(first(every("PMID"))), "title": _text(first(every("ArticleTitle"))), "journal": _text(first(below("Journal", "Title"))),
        "parts": [{"label": p.get("Label") or "", "body": _text(p)} for p in below("Abstract", "AbstractText")],
        "article_date": date(first(every("ArticleDate"))), "pub_date": date(published), "medline_date": "" if published is None else _text(published.find("MedlineDate")),
        "mesh_detail": [{"name": _text(h), "ui": h.get("UI") or None, "is_major": h.get("MajorTopicYN") == "Y"} for h in every("DescriptorName")],
        "publication_types": [t for t in map(_text, every("PublicationType")) if t], "keywords": [t for t in map(_text, every("Keyword")) if t],
    }


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (record) from batches of XML; each article is parsed once."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            found = [None if x is None else record_of(x) for x in batch.column(0).slice(k, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, ARROW_RECORD)], names=["record"])


def parse_articles(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """pmid, title, abstract, journal, pub_date, mesh_terms, mesh_detail, publication_types, keywords, primary_species, species_tags.

    Mixed content is joined; labelled abstract parts read "LABEL: text". Articles without an id are
    dropped, as are nulls and what is not well-formed XML (malformed() gives those). Empty keywords
    and types are left out. Other columns are not read. Empty table: no rows.
    """
    # Spark's own XML functions parse a record once for each field, or lose the text around marked-up parts
    r = F.col("record")
    rows = articles.select(F.col(f"`{xml}`")).mapInArrow(parse_records, StructType().add("record", RECORD)).filter(r.isNotNull() & (T.strip(r["pmid"]) != ""))

    def date(where: str) -> Column:
        return T.partial_date(T.strip(r[where]["year"]), F.nullif(T.strip(r[where]["month"]), F.lit("")), F.nullif(T.strip(r[where]["day"]), F.lit("")))

    nothing = F.lit(None).cast("string")
    dates = date("article_date"), date("pub_date"), T.partial_date(F.regexp_extract(r["medline_date"], r"\d{4}", 0), nothing, nothing)
    abstract = F.array_join(F.transform(r["parts"], lambda p: F.concat(F.when(p["label"] != "", F.concat(p["label"], F.lit(": "))).otherwise(""), T.strip(p["body"]))), " ")
    rows = rows.select(
        T.strip(r["pmid"]).alias("pmid"), T.strip(r["title"]).alias("title"), abstract.alias("abstract"), T.strip(r["journal"]).alias("journal"), F.coalesce(*[F.nullif(d, F.lit("")) for d in dates], F.lit("")).alias("pub_date"),
        F.transform(r["mesh_detail"], lambda d: d["name"]).alias("mesh_terms"), r["mesh_detail"].alias("mesh_detail"), r["publication_types"].alias("publication_types"), r["keywords"].alias("keywords"),
    )
    tags = T.species_tags(F.col("mesh_terms"))
    return rows.withColumn("primary_species", T.primary_species(tags)).withColumn("species_tags", tags)


def malformed(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of articles whose XML is not well-formed: rejects, as text."""

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for x in batch.column(0).to_pylist() if x is not None and record_of(x) is None], pa.string())], names=["xml"])

    return articles.select(F.col(f"`{xml}`")).mapInArrow(bad, "xml string")
