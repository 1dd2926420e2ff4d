"""Deterministic page samples.  Positions round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(count: Column, most: int) -> Column:
    """Indices of at most ``most`` pages of ``count``, evenly spread over first to last; empty for no pages."""
    if most < 1:
        raise ValueError("a sample needs at least one page")
    n = F.least(count, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (count - 1) / (n - 1), 0).cast("int"))
    return (
        F.when(count < 1, F.array().cast("array<int>"))
        .when(n == count, F.sequence(F.lit(0), (count - 1).cast("int")))
        .when(n == 1, F.array(F.lit(0)))
        .otherwise(spread)
    )


def _picked(values: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.element_at(values, i + 1))


def staged(count: Column, stages: tuple[int, ...] = (3, 5, 8)) -> list[Column]:
    """Nested samples, the smallest first: each stage samples the indices of the next larger one."""
    sizes = sorted(set(stages))
    if sizes[0] < 1:
        raise ValueError("a sample needs at least one page")
    current = even(count, sizes[-1])
    out = [current]
    for size in reversed(sizes[:-1]):
        larger = current
        current = _picked(larger, even(F.size(larger), size))
        out.append(current)
    return out[::-1]


#: By stage, the document's and the best candidate's confidence that end the analysis.
NEEDED = {3: (0.95, 0.95), 5: (0.90, 0.90)}


def first_confident(stage_rows, needed: dict[int, tuple[float, float]]):
    """Early stop without a loop: of a document's rows (document, stage, confidence, candidate_confidence, ...) the first
    stage whose two confidences reach ``needed[stage]``, else the last stage."""
    enough = F.lit(False)
    for stage, (doc, candidate) in needed.items():
        enough = enough | ((F.col("stage") == stage) & (F.col("confidence") >= doc) & (F.coalesce("candidate_confidence", F.lit(0.0)) >= candidate))
    ranked = stage_rows.withColumn("_key", F.struct(~enough, F.when(enough, F.col("stage")).otherwise(-F.col("stage"))))
    names = [c for c in stage_rows.columns if c != "document"]
    best = ranked.groupBy("document").agg(F.min_by(F.struct(*names), "_key").alias("b"))
    return best.select("document", *[F.col(f"b.{c}").alias(c) for c in names])
