"""Scoring and removal of repeated overlay streams (lines)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Scorer:
    """Markers, protected literals, and whether unmatched streams may be detected."""

    markers: tuple[str, ...]
    protected: tuple[str, ...] = ("Chapter ", "Figure ", "Table ", "A.", "B.", "C.", "D.")
    auto_detect: bool = False


def features(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Add what the score needs to know of a ``line``: length, matched, hits, hit, held, url, upper."""
    line = F.col("line")
    hits = F.array_compact(F.array(*[F.when(line.contains(x), F.lit(x)) for x in scorer.protected]))
    known = rows.withColumns({
        "length": F.octet_length("line"), "matched": T.matched(line, list(scorer.markers)), "hits": hits, "url": T.any_of(line, T.URL_HINTS), "upper": T.upper_ratio(line),
    })
    return known.withColumns({"hit": F.size("matched") > 0, "held": F.size("hits") > 0})


def scored(streams: DataFrame, scorer: Scorer) -> DataFrame:
    """Add length, matched, hits, score, auto, safe to rows with ``line`` and ``repeat_count``."""
    return judged(features(streams, scorer), scorer)


def judged(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Add score, auto, safe to rows with ``repeat_count`` and the features.

    Fixed values: the points and limits of the scoring table.
    """
    rep, hit, held = (F.col(c) for c in ("repeat_count", "hit", "held"))
    points = (
        F.when(hit, 65).otherwise(0)
        + F.when(F.col("length") <= 1800, 18).when(F.col("length") <= 5000, 8).when(F.col("length") > 12000, -30).otherwise(0)
        + F.when(rep >= 2, 18).otherwise(0)
        + F.when(rep >= 4, 10).otherwise(0)
        + F.when(F.col("url"), 10).otherwise(0)
        + F.when(F.col("upper") >= 0.70, 6).otherwise(0)
        - F.when(held, 90).otherwise(0)
    )
    marked = hit & ~held & (F.col("length") <= 5000)
    auto: Column = F.lit(scorer.auto_detect) & ~marked & ~hit & ~held & (rep >= 2) & (F.col("length") <= 2500) & (F.col("url") | (F.col("upper") >= 0.75))
    rows = rows.withColumn("auto", auto).withColumn("score", points + F.when(F.col("auto"), 25).otherwise(0))
    return rows.withColumn("safe", marked | (F.col("auto") & (F.col("score") >= 70)))


def distinct_streams(lines: DataFrame, scorer: Scorer) -> DataFrame:
    """document, stream (a 128-bit digest), sha1, repeat_count, first_doc and scores: each stream of a document once, with all its references
    counted.  What the score needs is taken from the lines where they are read, so no line is shuffled, only its digests and features."""
    narrow = features(lines, scorer).select("document", "doc_id", F.md5("line").alias("stream"), F.sha1("line").alias("sha1"), "length", "hit", "held", "url", "upper")
    keys = [c for c in narrow.columns if c != "doc_id"]
    return judged(narrow.groupBy(*keys).agg(F.count("*").alias("repeat_count"), F.min("doc_id").alias("first_doc")), scorer)


def candidates(lines: DataFrame, scorer: Scorer, least: int = 35) -> DataFrame:
    """Streams worth showing: safe, or with a score of at least ``least``."""
    return distinct_streams(lines, scorer).where(F.col("safe") | (F.col("score") >= least))


def in_order(rows: DataFrame) -> DataFrame:
    """Add ``place`` within the document: safe ones first, then by score, page (as text) and digest.

    Rows are numbered within one score of a document; each score begins where the ones before it end.  There are a few dozen
    scores, so no task holds a document's rows.
    """
    block = ["document", "safe", "score"]
    before = W.partitionBy("document").orderBy(~F.col("safe"), -F.col("score")).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*block).count().select(*block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy(*block).orderBy("page", "sha1"))
    return rows.withColumn("place", place).join(starts, block).withColumn("place", (F.col("start") + F.col("place")).cast("int")).drop("start")


def remove_safe(pages: DataFrame, lines: DataFrame, scorer: Scorer) -> DataFrame:
    """document, doc_id, text, n_removed: pages without the lines of safe streams.

    A page's safe streams are found on digests; then the lines of the page are filtered in place, so texts are joined once and
    never exploded and rebuilt.
    """
    safe = distinct_streams(lines, scorer).where("safe").select("document", "stream")
    own = lines.select("document", "doc_id", F.md5("line").alias("stream"))
    on_page = own.join(safe, ["document", "stream"], "left_semi").groupBy("document", "doc_id").agg(F.collect_set("stream").alias("safe_streams"))
    rows = pages.join(on_page, ["document", "doc_id"], "left")
    split = F.split("text", "\n")
    left = F.when(F.col("safe_streams").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("safe_streams", F.md5(x))))
    return rows.select("document", "doc_id", F.array_join(left, "\n").alias("text"), (F.size(split) - F.size(left)).alias("n_removed"))


def removal_summary(lines: DataFrame, scorer: Scorer) -> DataFrame:
    """document, removed_streams, changed_pages, skipped_streams.  A stream on several pages changes its first page."""
    rows = distinct_streams(lines, scorer)
    return rows.groupBy("document").agg(
        F.count(F.when(F.col("safe"), 1)).alias("removed_streams"),
        F.count_distinct(F.when(F.col("safe"), F.col("first_doc"))).alias("changed_pages"),
        F.count(F.when(~F.col("safe") & (F.col("score") >= 35), 1)).alias("skipped_streams"),
    )


def preserved(pages: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """document, doc_id, kept_chars, removed_chars: characters that must survive when marked lines may go."""
    keys = [m for m in ("".join(c for c in x.lower() if c.isalnum()) for x in markers) if m]

    def marked(line: Column) -> Column:
        folded = T.fold_simple(line)
        out = F.lit(False)
        for k in keys:
            out = out | folded.contains(k)
        return out

    split = F.split("text", "\n")
    kept = F.filter(split, lambda x: ~marked(x))
    gone = F.filter(split, marked)
    return pages.select(
        "document", "doc_id",
        F.length(F.trim(F.array_join(kept, "\n"))).alias("kept_chars"),
        F.aggregate(gone, F.lit(0), lambda a, x: a + F.length(x)).alias("removed_chars"),
    )
