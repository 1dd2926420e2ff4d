"""Bindings of the corpus tables to documents, pages and page fragments.

``documents``: a document is a source, its pages are the rows in the order of doc_id, a page's streams are its lines.
``pages``: a document is a host, fragments are its navigation, footer and advertisement elements.
``embeddings``: a document is a label, a page is an 8x8 gray raster.  ``events``: a job is a user.
These are stand-ins; the operators take any DataFrame with the named columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids per numbering block, as a power of two.
BLOCK_BITS = 12
FRAGMENT = r"(?s)(<nav>.*?</nav>|<footer>.*?</footer>|<div class=\"ad\">.*?</div>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(docs: DataFrame) -> DataFrame:
    """document, doc_id, text."""
    return docs.select(F.col("source").alias("document"), "doc_id", "text")


def numbered(pages: DataFrame) -> DataFrame:
    """Page indices (document, doc_id, page_index), without a sort of a whole document.

    Ids are numbered inside blocks; a block begins where the blocks before it in its document end.  The block table has one
    row per 4096 ids, and only ids are shuffled.
    """
    rows = pages.select("document", "doc_id", F.shiftright("doc_id", BLOCK_BITS).alias("block"))
    before = W.partitionBy("document").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("document", "block").count().select("document", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("document", "block").orderBy("doc_id"))
    return (
        rows.withColumn("place", place)
        .join(starts, ["document", "block"])
        .select("document", "doc_id", (F.col("start") + F.col("place") - 1).cast("int").alias("page_index"))
    )


def lines(pages: DataFrame) -> DataFrame:
    """document, doc_id, line_no, line of every line with something on it."""
    return pages.select("document", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def host(url: str) -> Column:
    return F.regexp_extract(url, r"https?://([^/]+)", 1)


def fragments(pages: DataFrame) -> DataFrame:
    """document, page_id, fragment: overlay elements of web pages."""
    return pages.select(
        host("url").alias("document"), "page_id", F.explode(F.regexp_extract_all("html", F.lit(FRAGMENT), 1)).alias("fragment")
    )


def rasters(embeddings: DataFrame) -> DataFrame:
    """document, page_id, pixel, gray: values in [-1, 1] become half-even rounded gray levels."""
    exploded = embeddings.select(F.col("label").alias("document"), F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("pixel", "value"))
    gray = F.bround((F.col("value").cast("double") + 1) * 127.5, 0)
    return exploded.select("document", "page_id", "pixel", F.greatest(F.lit(0), F.least(F.lit(255), gray.cast("int"))).alias("gray"))
