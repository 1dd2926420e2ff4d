"""Before/after checks and their verdicts.  An absent metric passes its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The gates; a larger value fails.
OUTSIDE, RESIDUAL, FOOTER, PROTECTED = 0.08, 0.08, 0.035, 0.002
CHANGED = 24


def outside_change(pixels: DataFrame, allowed: str = "false", least: int = CHANGED, page_limit: float = OUTSIDE) -> DataFrame:
    """document, n_pages, outside_change_ratio (all pixels of all pages), n_failed_pages.

    ``pixels``: document, page_id, gray, fixed; ``allowed``: condition of pixels that may change.
    """
    outside = ~F.expr(allowed)
    pages = pixels.groupBy("document", "page_id").agg(
        F.count_if(outside & (F.abs(F.col("gray") - F.col("fixed")) >= least)).alias("changed"), F.count_if(outside).alias("n")
    )
    page_ratio = F.col("changed") / F.greatest(F.lit(1), F.col("n"))
    return pages.groupBy("document").agg(
        F.count("*").alias("n_pages"),
        (F.sum("changed") / F.greatest(F.lit(1), F.sum("n"))).alias("outside_change_ratio"),
        F.count_if(page_ratio > page_limit).alias("n_failed_pages"),
    )


def verdict(metrics: DataFrame) -> DataFrame:
    """Add ok and reasons to rows with page_count_ok, geometry_ok, outside_change_ratio, residual, footer_residual,
    protected_change (the last four may be null).  The first failing structural check hides the metric gates."""
    passes = lambda c, limit: F.coalesce(F.col(c) <= limit, F.lit(True))
    gates = F.array_compact(F.array(
        F.when(~passes("footer_residual", FOOTER), F.lit("footer_residual")),
        F.when(~passes("protected_change", PROTECTED), F.lit("protected_change")),
        F.when(~passes("residual", RESIDUAL), F.lit("residual")),
        F.when(~passes("outside_change_ratio", OUTSIDE), F.lit("outside_change")),
    ))
    reasons = F.when(~F.col("page_count_ok"), F.array(F.lit("page_count"))).when(~F.col("geometry_ok"), F.array(F.lit("geometry"))).otherwise(gates)
    return metrics.withColumn("reasons", F.array_join(reasons, ",")).withColumn("ok", F.col("reasons") == "")


def under_mode(verdicts: DataFrame, mode: str) -> DataFrame:
    """Verdicts as the settings want them: with ``off`` in the column ``mode`` nothing is held against a document."""
    off = F.col(mode) == "off"
    return verdicts.withColumns({"ok": off | F.col("ok"), "reasons": F.when(off, "").otherwise(F.col("reasons"))})


def page_report(pages: DataFrame, cleaned: DataFrame, least_kept: float = 0.98) -> DataFrame:
    """document, doc_id, chars_before, chars_after, kept_ratio, status of each page; joined on the page."""
    before = pages.select("document", "doc_id", F.length("text").alias("chars_before"))
    after = cleaned.select("document", "doc_id", F.length("text").alias("chars_after"))
    ratio = F.coalesce(F.col("chars_after"), F.lit(0)) / F.greatest(F.lit(1), F.col("chars_before"))
    status = F.when(F.col("chars_after").isNull(), "failed").when(ratio < least_kept, "warned").otherwise("passed")
    return before.join(after, ["document", "doc_id"], "left").withColumn("kept_ratio", ratio).withColumn("status", status)


def summary(report: DataFrame) -> DataFrame:
    """document, n_pages, n_failed, n_warned, ok; the pages themselves are rows of the report."""
    return report.groupBy("document").agg(
        F.count("*").alias("n_pages"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("failed", "warned")], (F.count_if(F.col("status") == "failed") == 0).alias("ok")
    )


#: Blocks into which a metric's range is cut to find its median.
BLOCKS = 4096


def benchmark_medians(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Exact median of each metric per key; nulls are left out.

    A key's range is cut into blocks, and counts tell which block holds the middle; only that block's values are put in order, so
    no task or aggregate holds a key's values.
    """
    out = runs.groupBy(key).agg(F.count("*").alias("n_runs"))
    for m in metrics:
        out = out.join(_median(runs.select(key, F.col(m).cast("double").alias("value")).where("value is not null and not isnan(value)"), key).withColumnRenamed("median", f"{m}_median"), key, "left")
    return out


def _median(rows: DataFrame, key: str) -> DataFrame:
    bounds = rows.groupBy(key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    placed = rows.join(bounds, key).withColumn("block", F.least(F.lit(BLOCKS - 1), F.floor(share * BLOCKS)).cast("int"))
    counts = placed.groupBy(key, "block", "n").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(W.partitionBy(key).orderBy("block"))
    middle = counts.withColumn("upto", upto).withColumn("begin", F.col("upto") - F.col("here"))
    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = middle.where((F.col("begin") <= last) & (F.col("upto") > first)).select(key, "block", "begin")
    values = placed.join(middle, [key, "block"]).groupBy(key, "block", "begin", "n", "value").agg(F.count("*").alias("times"))
    end = F.col("begin") + F.sum("times").over(W.partitionBy(key, "block").orderBy("value"))
    # A value stands at the ranks from its end less its times up to its end.
    at = values.withColumn("end", end).withColumn("hits", sum((((F.col("end") - F.col("times")) <= r) & (F.col("end") > r)).cast("int") for r in (first, last)))
    return at.groupBy(key).agg((F.sum(F.col("value") * F.col("hits")) / F.sum("hits")).alias("median"))
