"""The document job: analyse, plan, execute, check, publish; every step for all documents at once.

``process`` is the entry point.  A document whose plan is ``stream_remove`` loses its safe streams; all others pass through unchanged
(``used_fallback``).  Results are published only for documents that pass the checks: a failed one keeps its original pages.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, kernels, routing, sampling, streams
from ..sources import files

STAGES = ("queued", "analyzing", "planning", "processing", "verifying", "done")
ENDED = ("done", "failed", "cancelled")


class Cancelled(Exception):
    """The caller asked to stop."""


@dataclass
class Job:
    """Events of one run; a listener may poll ``since`` with the last id it has seen."""

    events: list[dict] = field(default_factory=list)
    should_cancel: Callable[[], bool] = lambda: False
    most: int = 1000

    def emit(self, stage: str, message: str = "") -> None:
        last = self.events[-1]["id"] if self.events else 0
        done = 100.0 if stage in ENDED else round(100.0 * STAGES.index(stage) / (len(STAGES) - 1), 2)
        self.events.append({"id": last + 1, "time": time.time(), "stage": stage, "percent": done, "message": message})
        del self.events[: -self.most]

    def since(self, cursor: int) -> tuple[list[dict], int, bool]:
        new = [e for e in self.events if e["id"] > cursor]
        last = self.events[-1] if self.events else {"id": cursor, "stage": "queued"}
        return new, last["id"], last["stage"] in ENDED

    def step(self, stage: str) -> None:
        if self.should_cancel():
            self.emit("cancelled")
            raise Cancelled
        self.emit(stage)


def analyze_staged(pages: DataFrame, registry: list[dict], stages: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """Profiles with their best candidates from the smallest nested sample that is sure enough, else from the largest one.

    All samples of all documents are analysed at once, as documents of their own; ``stage`` tells which one counts.  At most
    ``max(stages)`` pages of a document are read.
    """
    samples = analysis.staged_pages(pages, stages)
    keyed = pages.join(samples, ["document", "doc_id"]).withColumn("document", F.concat("document", F.lit("#"), F.col("stage").cast("string"))).drop("stage")
    found = analyze(keyed, registry).withColumns({"stage": F.substring_index("document", "#", -1).cast("int"), "document": F.regexp_replace("document", "#[0-9]+$", "")})
    return sampling.first_confident(found, sampling.NEEDED)


def analyze(pages: DataFrame, registry: list[dict]) -> DataFrame:
    """Profiles with their best candidates, from all pages."""
    ratios = analysis.ratios(analysis.page_evidence(pages))
    kind, sure = analysis.classify(F.col("text_layer_ratio"), F.col("full_page_image_ratio"))
    best = routing.best_candidate(analysis.candidates(pages, registry))
    return ratios.withColumns({"kind": kind, "confidence": sure}).join(best, "document", "left")


def plan(profiles: DataFrame, preference: str = "auto_smart", content_profile: str = "auto") -> DataFrame:
    return routing.apply_preference(routing.plan(profiles, content_profile), preference)


def execute(pages: DataFrame, lines: DataFrame, plans: DataFrame, registry: list[dict]) -> DataFrame:
    """document, doc_id, text, n_removed, used_fallback of all pages."""
    markers = tuple(a for s in registry for a in s["aliases"])
    if not markers:
        raise ValueError("stream removal needs markers")
    chosen = plans.select("document", (F.col("strategy") == "stream_remove").alias("_clean"))
    cleaned = streams.remove_safe(pages, lines, streams.Scorer(markers)).withColumnRenamed("text", "_cleaned")
    joined = pages.join(cleaned, ["document", "doc_id"]).join(chosen, "document")
    return joined.select(
        "document", "doc_id", F.when(F.col("_clean"), F.col("_cleaned")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_clean"), F.col("n_removed")).otherwise(0).alias("n_removed"), (~F.col("_clean")).alias("used_fallback"),
    )


#: Fixed value: confidence below which a shared overlay is no ground for a repair.
LEAST_MODEL = 0.55


def execute_rasters(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """document, page_id, data, changed, reason of image pages (``kernels.PAGE``) under their documents' plans (document, strategy).

    ``raster_template`` repairs a page with its document's model.  Where that cannot be done, and for any other strategy, the page falls back to
    what it was, and ``reason`` says why.
    """
    planned = pages.join(plans.select("document", "strategy"), "document")
    models = kernels.learn_models(planned.where("strategy = 'raster_template'").select(*pages.columns)).select("document", "mask", "confidence")
    reason = (
        F.when(F.col("strategy") != "raster_template", F.concat(F.lit("strategy "), F.col("strategy")))
        .when(F.col("mask").isNull(), "too few samples")
        .when((F.col("confidence") < LEAST_MODEL), "weak consensus")
    )
    rows = planned.join(models, "document", "left").withColumn("reason", reason)

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples():
                data, changed = row.data, 0
                if row.reason is None:
                    page = kernels.to_page(row)
                    fixed, changed = kernels.repair(page, np.frombuffer(row.mask, np.uint8).reshape(page.shape[:2]) > 0)
                    data = np.ascontiguousarray(fixed).tobytes()
                out.append((row.document, row.page_id, data, changed, row.reason))
            yield pd.DataFrame(out, columns=["document", "page_id", "data", "changed", "reason"])

    columns = ["document", "page_id", "height", "width", "channels", "data", "reason", F.when(F.col("reason").isNull(), F.col("mask")).alias("mask")]
    return rows.select(*columns).mapInPandas(run, "document string, page_id long, data binary, changed long, reason string")


def check(pages: DataFrame, result: DataFrame, registry: list[dict], least_kept: float = 0.98) -> DataFrame:
    """document, ok: no page lost more than the marked lines it may lose."""
    markers = tuple(a for s in registry for a in s["aliases"])
    must = streams.preserved(pages, markers).select("document", "doc_id", "kept_chars")
    after = result.select("document", "doc_id", F.length(F.trim("text")).alias("chars"))
    kept = must.join(after, ["document", "doc_id"], "left")
    return kept.groupBy("document").agg(F.min(F.coalesce("chars", F.lit(0)) >= least_kept * F.col("kept_chars")).alias("ok"))


def process(
    spark: SparkSession, pages: DataFrame, lines: DataFrame, folder: str, name: str, preference: str = "auto_smart", registry: list[dict] | None = None, job: Job | None = None
) -> dict:
    """Clean all documents and publish the result as ``folder/name``; returns a report."""
    registry, job = registry or files.load_signatures(), job or Job()
    out, seconds = files.Publisher(spark, folder), {}
    job.emit("queued")

    def timed(stage: str, f):
        job.step(stage)
        began = time.perf_counter()
        value = f()
        seconds[stage] = round(time.perf_counter() - began, 3)
        return value

    staged = final = None
    try:
        profiles = timed("analyzing", lambda: analyze_staged(pages, registry))
        plans = timed("planning", lambda: plan(profiles, preference))
        staged = timed("processing", lambda: out.stage(execute(pages, lines, plans, registry)))
        result = spark.read.parquet(f"{out.folder}/{staged}")

        def verified() -> tuple[str, dict]:
            verdicts = check(pages, result, registry)
            # A failed document keeps its original pages.
            final = result.join(verdicts, "document").join(pages.withColumnRenamed("text", "_before"), ["document", "doc_id"])
            final = final.withColumn("text", F.when(F.col("ok"), F.col("text")).otherwise(F.col("_before"))).drop("_before")
            name = out.stage(final)
            counts = spark.read.parquet(f"{out.folder}/{name}").agg(
                F.count_distinct("document").alias("documents"), F.count_distinct(F.when(~F.col("ok"), F.col("document"))).alias("rejected"),
                F.sum("n_removed").alias("removed"), F.count_distinct(F.when(F.col("used_fallback"), F.col("document"))).alias("fallback"),
            ).first()
            return name, counts.asDict()

        final, counts = timed("verifying", verified)
        backup = out.promote(final, name)
        final = None  # it is published
    except Cancelled:
        raise
    except Exception as e:
        job.emit("failed", str(e)[:200])
        raise
    finally:
        for left in filter(None, (staged, final)):
            out.reject(left)
    job.emit("done")
    return {"output": f"{out.folder}/{name}", "backup": backup, "seconds": seconds, "total_seconds": round(sum(seconds.values()), 3), **counts}
