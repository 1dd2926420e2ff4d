"""Document analysis: page evidence, repetition, classification, candidates, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables
from . import sampling

SYMBOLS = r"[#*$%&|<>]"


def page_evidence(pages: DataFrame) -> DataFrame:
    """document, doc_id, text_coverage, image_coverage, text_char_count.  The share of symbols stands in for images."""
    text = F.trim(F.coalesce("text", F.lit("")))
    chars = F.length(text)
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.lit(1), chars)
    return pages.select(
        "document", "doc_id",
        F.when(chars > 0, 1.0).otherwise(0.0).alias("text_coverage"),
        F.least(F.lit(1.0), symbols).alias("image_coverage"),
        chars.alias("text_char_count"),
    )


def ratios(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("document").agg(
        F.count("*").alias("page_count"),
        F.avg((F.col("text_char_count") > 0).cast("int")).alias("text_layer_ratio"),
        F.avg("image_coverage").alias("full_page_image_ratio"),
    )


def classify(text_ratio: Column, image_ratio: Column) -> tuple[Column, Column]:
    """Kind and confidence of a document."""
    raster = (image_ratio >= 0.8) & (text_ratio <= 0.2)
    vector = (text_ratio >= 0.8) & (image_ratio < 0.15)
    kind = F.when(raster, "raster").when(vector, "vector").otherwise("hybrid")
    sure = F.when(raster, F.greatest(image_ratio, 1 - text_ratio)).when(vector, F.greatest(text_ratio, 1 - image_ratio)).otherwise(F.lit(0.8))
    return kind, sure


def staged_profiles(pages: DataFrame, stages: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """document, stage, page_count, ratios, kind and confidence of each nested sample of each document, all at once.

    Only the pages of the largest sample are measured, at most ``max(stages)`` of a document.
    """
    samples = staged_pages(pages, stages)
    wanted = samples.select("document", "doc_id").distinct()
    evidence = page_evidence(pages.join(wanted, ["document", "doc_id"], "left_semi"))
    keyed = evidence.join(samples, ["document", "doc_id"]).withColumn("document", F.struct("document", "stage"))
    rows = ratios(keyed).select("document.document", "document.stage", "page_count", "text_layer_ratio", "full_page_image_ratio")
    kind, sure = classify(F.col("text_layer_ratio"), F.col("full_page_image_ratio"))
    return rows.withColumns({"kind": kind, "confidence": sure})


def staged_pages(pages: DataFrame, stages: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """document, stage, doc_id of the pages of the nested samples; worked out on ids alone."""
    ids = pages.select("document", "doc_id")
    counts = ids.groupBy("document").agg(F.count("*").cast("int").alias("n"))
    lists = sampling.staged(F.col("n"), stages)
    each = F.array(*[F.struct(F.lit(s).alias("stage"), a.alias("at")) for s, a in zip(sorted(set(stages)), lists)])
    at = counts.select("document", F.explode(each).alias("s")).select("document", "s.stage", F.explode("s.at").alias("page_index"))
    return tables.numbered(ids).join(at, ["document", "page_index"]).select("document", "stage", "doc_id")


def page_streams(pages: DataFrame) -> DataFrame:
    """document, doc_id, line: each different line of a page once."""
    distinct = F.explode(F.array_distinct(F.split("text", "\n")))
    return pages.select("document", "doc_id", distinct.alias("line")).where(F.trim("line") != "")


def repeated_on_pages(pages: DataFrame, least: int = 2) -> DataFrame:
    """document, sha256, n_pages of lines on several pages: a page counts once however often it holds the line."""
    return (
        page_streams(pages).select("document", F.sha2("line", 256).alias("sha256")).groupBy("document", "sha256").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
    )


def reference_counts(lines: DataFrame) -> DataFrame:
    """document, sha1, n_references: every reference counts, also several on one page."""
    return lines.select("document", F.sha1("line").alias("sha1")).groupBy("document", "sha1").agg(F.count("*").alias("n_references"))


def signature_flags(pages: DataFrame, registry: list[dict]) -> DataFrame:
    """document, doc_id, id of the signatures that a page's text holds.

    The registry is a handful of literals from a file, so matching is one projection of the scan; nothing is joined.
    """
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]", "")
    keys = {s["id"]: ["".join(c for c in a.lower() if c.isascii() and c.isalnum()) for a in s["aliases"]] for s in registry}
    hits = []
    for name, aliases in keys.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.col("_t").contains(a)
        hits.append(F.when(hit, F.lit(name)))
    return (
        pages.select("document", "doc_id", text.alias("_t"))
        .select("document", "doc_id", F.explode(F.array_compact(F.array(*hits))).alias("id"))
    )


def candidates(pages: DataFrame, registry: list[dict]) -> DataFrame:
    """document, marker, n_pages, repeated, confidence of each signature in each document."""
    flags = signature_flags(pages, registry)
    counts = pages.groupBy("document").agg(F.count("*").alias("page_count"))
    # Pages with a signature are few: only their lines are looked up among the repeated ones.
    flagged = flags.select("document", "doc_id").distinct()
    lines = page_streams(pages).select("document", "doc_id", F.sha2("line", 256).alias("sha256"))
    repeated = repeated_on_pages(pages).select("document", "sha256")
    holding = lines.join(flagged, ["document", "doc_id"], "left_semi").join(repeated, ["document", "sha256"], "left_semi")
    on_page = holding.select("document", "doc_id").distinct().withColumn("has", F.lit(True))
    per = flags.join(on_page, ["document", "doc_id"], "left").groupBy("document", "id").agg(
        F.count("*").alias("n_pages"), F.max(F.coalesce("has", F.lit(False))).alias("repeated")
    )
    sure = F.least(F.lit(1.0), 0.45 + 0.35 * F.col("n_pages") / F.col("page_count") + F.when(F.col("repeated"), 0.20).otherwise(0.0))
    return per.join(counts, "document").select("document", F.col("id").alias("marker"), "n_pages", "repeated", sure.alias("confidence"))


def fingerprint(content: Column, edge: int = 65536) -> Column:
    """sha256 of the size and the content, or of both ends of a long one."""
    raw = F.encode(content, "UTF-8")
    n = F.length(raw)
    body = F.when(n <= 2 * edge, raw).otherwise(F.concat(F.substring(raw, 1, edge), F.substring(raw, -edge, edge)))
    return F.sha2(F.concat(F.encode(F.concat(F.lit("size:"), n.cast("string"), F.lit(":")), "UTF-8"), body), 256)


def lru(accesses: DataFrame, key: str, at: str, size: int = 32) -> DataFrame:
    """The ``size`` keys accessed last: key, last_access, hits.  A global top-k, not a sort."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_access"), F.count("*").alias("hits"))
    return last.orderBy(F.desc("last_access"), key).limit(size)


def top_repeats(counts: DataFrame, n: int) -> DataFrame:
    return counts.withColumn("r", F.row_number().over(W.partitionBy("document").orderBy(F.desc("n_pages"), "sha256"))).where(F.col("r") <= n)
