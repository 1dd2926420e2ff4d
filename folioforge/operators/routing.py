"""Routing: the best candidate, the decision table, preferences, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTENT_PROFILES = ("auto", "math", "physics", "chemistry", "ebook")
LEGACY_MODES = {"auto": "toan", "math": "toan", "physics": "ly", "chemistry": "hoa", "ebook": "ebook"}


def check_profile(name: str) -> str:
    if name not in CONTENT_PROFILES:
        raise ValueError(f"unknown content profile {name!r}")
    return name


def best_candidate(candidates: DataFrame) -> DataFrame:
    """document, marker, repeated, confidence of the most confident candidate; of equals the first by name."""
    key = F.struct(-F.col("confidence"), F.col("marker"))
    best = candidates.groupBy("document").agg(F.min_by(F.struct("marker", "repeated", "confidence"), key).alias("b"))
    return best.select("document", "b.marker", "b.repeated", F.col("b.confidence").alias("candidate_confidence"))


def plan(profiles: DataFrame, content_profile: str = "auto") -> DataFrame:
    """Strategy of each profile (document, kind, confidence, full_page_image_ratio, marker, repeated,
    candidate_confidence); the order of the rules matters."""
    check_profile(content_profile)
    sure, doc, image = F.col("candidate_confidence"), F.col("confidence"), F.col("full_page_image_ratio")
    raster = (F.col("kind") == "raster") & (image >= 0.8)
    weak = sure.isNull() | (sure < 0.70)
    stream = (sure >= 0.95) & F.coalesce("repeated", F.lit(False))
    strategy = F.when(raster, "raster_template").when(weak, "legacy").when(stream, "stream_remove").otherwise("vector_remove")
    confidence = F.when(raster, F.least(doc, F.coalesce(sure, F.lit(0.85)))).when(weak, F.coalesce(sure, F.least(doc, F.lit(0.69)))).otherwise(sure)
    reason = (
        F.when(raster, "page images dominate").when(weak, "too little evidence").when(stream, "confident repeated stream").otherwise("vector evidence, strict checks")
    )
    return profiles.withColumns({"strategy": strategy, "plan_confidence": confidence, "reason": reason}).withColumn(
        "requires_strict_qc",
        F.when(F.col("strategy") == "raster_template", F.col("plan_confidence") < 0.95).otherwise(F.col("strategy") == "vector_remove"),
    ).withColumn("content_profile", F.lit(content_profile))


#: Strategy that a preference insists on.
NEEDED = {"stream_clean": "stream_remove", "raster_clean": "raster_template"}


def apply_preference(plans: DataFrame, preference: str = "auto_smart") -> DataFrame:
    """Plans under a preference; ``rejected`` marks documents that it does not suit."""
    if preference not in ("auto_smart", "compatibility_clean", *NEEDED):
        raise ValueError(f"unknown preference {preference!r}")
    need = NEEDED.get(preference)
    out = plans.withColumn("requested_engine", F.lit(preference)).withColumn("rejected", (F.col("strategy") != need) if need else F.lit(False))
    return out.withColumn("strategy", F.lit("legacy")) if preference == "compatibility_clean" else out


def ordered_parts(parts: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Put the parts of each key into order again: key, n_parts, joined, complete (indices are 0 to n - 1)."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("p"))
    n = F.size("p")
    return rows.select(
        key, n.alias("n_parts"), F.array_join(F.transform("p", lambda x: x[value]), "\n").alias("joined"),
        ((F.element_at("p", 1)[index] == 0) & (F.element_at("p", -1)[index] == n - 1)).alias("complete"),
    )
