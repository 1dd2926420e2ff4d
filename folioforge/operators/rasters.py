"""Raster operators that are aggregations over pixels: rows (document, page_id, pixel, gray)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b, 0).cast("int")


def consensus(pixels: DataFrame, most_mad: float = 5.5, low: float = 125, high: float = 246, least_contrast: float = 4) -> DataFrame:
    """Per document and pixel: median and MAD over the pages, and whether the pixel belongs to the overlay.

    The background of a small raster is the document's mean median.  Medians are exact; the deviation pass joins the medians
    back on (document, pixel), an equi-join that a large document spreads over all its pixels.
    """
    key = ["document", "pixel"]
    med = pixels.groupBy(*key).agg(F.median("gray").alias("med"), F.count("*").alias("samples")).where("samples >= 2")
    mad = pixels.join(med, key).groupBy(*key, "med", "samples").agg(F.median(F.abs(F.col("gray") - F.col("med"))).alias("mad"))
    background = F.avg("med").over(W.partitionBy("document"))
    mask = (F.col("mad") <= most_mad) & F.col("med").between(low, high) & (F.col("background") - F.col("med") >= least_contrast)
    return mad.withColumn("background", background).withColumn("in_mask", mask)


def consensus_confidence(model: DataFrame) -> DataFrame:
    """document, support, confidence of a consensus model; 0 for an empty mask."""
    inside = F.col("in_mask")
    rows = model.groupBy("document").agg(
        F.avg(inside.cast("int")).alias("support"), F.avg(F.when(inside, F.col("mad"))).alias("noise")
    )
    stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("noise") / 12))
    value = 0.55 + 0.30 * stable + 0.15 * F.least(F.lit(1.0), F.col("support") / 0.02)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(0.98), value))
    return rows.select("document", "support", F.when(F.col("support") > 0, bounded).otherwise(0.0).alias("confidence"))


def repaired(pixels: DataFrame, model: DataFrame, gain: int = 24, dark: int = 105) -> DataFrame:
    """Lift overlay pixels towards the background; dark content is never touched: adds ``fixed``."""
    mask = model.where("in_mask").select("document", "pixel", "background")
    rows = pixels.join(mask, ["document", "pixel"], "left")
    lift = F.greatest(F.col("gray"), F.least(F.lit(255), F.bround(F.greatest(F.col("background") + 4, F.col("gray") + gain), 0).cast("int")))
    return rows.withColumn("fixed", F.when(F.col("background").isNotNull() & (F.col("gray") > dark), lift).otherwise(F.col("gray")))


def residual(fixed: DataFrame, least: int = 3) -> DataFrame:
    """document, page_id, candidates, acted, residual: remaining over original contrast of overlay pixels."""
    before = F.greatest(F.lit(0.0), F.col("background") - F.col("gray"))
    after = F.greatest(F.lit(0.0), F.col("background") - F.col("fixed"))
    candidate = F.col("background").isNotNull()
    acted = candidate & (F.abs(F.col("fixed") - F.col("gray")) >= least)
    rows = fixed.groupBy("document", "page_id").agg(
        F.count_if(candidate).alias("candidates"), F.count_if(acted).alias("acted"),
        F.sum(F.when(acted, before)).alias("was"), F.sum(F.when(acted, after)).alias("left"),
    )
    value = F.when(F.col("acted") == 0, F.when(F.col("candidates") > 0, 1.0).otherwise(0.0)).otherwise(
        F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("left"), F.col("was")), F.lit(0.0)))
    )
    return rows.select("document", "page_id", "candidates", "acted", value.alias("residual"))


def guided_rollup(fixed: DataFrame, least: int = 3) -> DataFrame:
    """document, n_pages, residual (worst page), changed_ratio (all pixels)."""
    changed = fixed.groupBy("document", "page_id").agg(F.count("*").alias("n"), F.count_if(F.col("fixed") != F.col("gray")).alias("changed"))
    rows = changed.join(residual(fixed, least), ["document", "page_id"])
    return rows.groupBy("document").agg(
        F.count("*").alias("n_pages"), F.max("residual").alias("residual"), (F.sum("changed") / F.greatest(F.lit(1), F.sum("n"))).alias("changed_ratio")
    )


def otsu(pixels: DataFrame) -> DataFrame:
    """document, threshold with the largest between-class variance of the gray histogram; of equals the lowest.

    The histogram has 256 bins at most per document; cumulative sums run over bins, not pixels.
    """
    histogram = pixels.groupBy("document", "gray").agg(F.count("*").cast("double").alias("n"))
    upto, whole = W.partitionBy("document").orderBy("gray"), W.partitionBy("document")
    sums = histogram.select(
        "document", "gray",
        F.sum("n").over(upto).alias("w0"), F.sum("n").over(whole).alias("w"),
        F.sum(F.col("n") * F.col("gray")).over(upto).alias("s0"), F.sum(F.col("n") * F.col("gray")).over(whole).alias("s"),
    ).where("w0 < w")
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2)
    return sums.withColumn("v", F.round(between, 3)).groupBy("document").agg(F.min_by("gray", F.struct(-F.col("v"), F.col("gray"))).alias("threshold"))


def row_means(pixels: DataFrame, width: int = 8) -> DataFrame:
    return pixels.withColumn("y", F.floor(F.col("pixel") / width).cast("int")).groupBy("document", "page_id", "y").agg(F.avg("gray").alias("mean"))


def moving_median(rows: DataFrame, value: str, half: int = 1, height: int = 8) -> DataFrame:
    """Median of each row's neighbourhood, edges repeated: adds ``smooth``.  A page has ``height`` rows."""
    line = W.partitionBy("document", "page_id").orderBy("y").rowsBetween(-half, half)
    whole = W.partitionBy("document", "page_id").orderBy("y").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.array_repeat(F.first(value).over(whole), F.greatest(F.lit(0), half - F.col("y")))
    after = F.array_repeat(F.last(value).over(whole), F.greatest(F.lit(0), F.col("y") + half - (height - 1)))
    padded = F.array_sort(F.concat(before, F.collect_list(value).over(line), after))
    return rows.withColumn("smooth", F.element_at(padded, half + 1))


def ruled_rows(rows: DataFrame, least: float = 4.0) -> DataFrame:
    """document, n_lines, spacing, spread of rows that are darker than their smoothed neighbourhood on average."""
    mean = rows.groupBy("document", "y").agg(F.avg(F.col("smooth") - F.col("mean")).alias("score")).where(F.col("score") >= least)
    gaps = mean.withColumn("gap", F.col("y") - F.lag("y").over(W.partitionBy("document").orderBy("y")))
    return gaps.groupBy("document").agg(F.count("*").alias("n_lines"), F.median("gap").alias("spacing"), (F.max("y") - F.min("y")).alias("spread"))


def band(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float, width: float, columns: int = 8) -> DataFrame:
    """Add ``in_band``: the pixel's distance from the segment is at most ``width``."""
    x, y = F.col("pixel") % columns, F.floor(F.col("pixel") / columns)
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
    distance = F.sqrt(F.pow(x - x0 - t * dx, 2) + F.pow(y - y0 - t * dy, 2))
    return pixels.withColumn("in_band", distance <= width)


def native_choice(placements: DataFrame, least: float = 0.95) -> DataFrame:
    """Pages with exactly one different placement (document, page_id, image, box rounded) that covers them."""
    one = placements.dropDuplicates(["document", "page_id", "image", "x0", "y0", "x1", "y1"])
    return one.groupBy("document", "page_id").agg(F.count("*").alias("n"), F.max("coverage").alias("coverage"), F.first("image").alias("image")).where(
        (F.col("n") == 1) & (F.col("coverage") >= least)
    )


def hybrid_choice(changed: Column, coverage: Column, patches: Column, seam: Column) -> Column:
    """Whether a page is replaced as a whole or by patches."""
    return F.when((changed > 0.42) | (coverage > 0.62) | (patches > 120) | seam, "full_raster").otherwise("hybrid")


def lowest_group(rows: DataFrame) -> DataFrame:
    """document, page_id, first_row, last_row of the lowest group of neighbouring rows (document, page_id, y)."""
    island = F.col("y") - F.row_number().over(W.partitionBy("document", "page_id").orderBy("y"))
    groups = rows.withColumn("island", island).groupBy("document", "page_id", "island").agg(F.min("y").alias("first_row"), F.max("y").alias("last_row"))
    lowest = groups.groupBy("document", "page_id").agg(F.max_by(F.struct("first_row", "last_row"), "last_row").alias("g"))
    return lowest.select("document", "page_id", "g.first_row", "g.last_row")
