"""Guided cleaning of pages that are one native image: probe, safety checks, page pass, page metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import footer
from . import inkpages as I
from . import kernels as K
from . import ruledpages as R


def normalise(page) -> np.ndarray:
    """An RGB ``uint8`` page: the first of several results, gray repeated, values clipped; other shapes are refused."""
    if isinstance(page, (tuple, list)):
        page = page[0]
    page = np.asarray(page)
    if page.ndim == 2:
        page = np.repeat(page[..., None], 3, 2)
    if page.ndim != 3 or page.shape[2] not in (3, 4):
        raise ValueError(f"unsupported page shape {page.shape}")
    return np.clip(page[..., :3], 0, 255).astype(np.uint8)


def work_size(native: tuple[int, int], points: tuple[float, float], dpi: int = 150) -> tuple[int, int]:
    """Height and width to work at: the page at ``dpi``, never above the native image."""
    return tuple(max(1, min(n, round(p * dpi / 72))) for n, p in zip(native, points))


#: The line along which the known overlay lies, as shares of the page, and where the part that counts begins.
PRIOR_LINE, PRIOR_FROM = (0.50, 0.98, 0.98, 0.52), 0.42


def work_side(native: Column, points: Column, dpi: int = 150) -> Column:
    """The same for a column of sides."""
    return F.least(native, F.greatest(F.lit(1), F.bround(points * dpi / 72, 0).cast("int")))


def diagonal_prior(shape: tuple[int, int]) -> np.ndarray:
    """The lower right part of the band around the known overlay's line."""
    h, w = shape
    x0, y0, x1, y1 = (v * s for v, s in zip(PRIOR_LINE, (w, h, w, h)))
    y, x = np.mgrid[:h, :w]
    dx, dy = x1 - x0, y1 - y0
    off = abs(dy * (x - x0) - dx * (y - y0)) / max(1.0, float(np.hypot(dx, dy)))
    return (x >= PRIOR_FROM * w) & (y >= PRIOR_FROM * h) & (off <= max(10.0, 0.11 * min(h, w)))


def probe_page(page: np.ndarray, s: R.Settings = R.Settings(), least: float = 0.001) -> tuple[bool, float]:
    """Whether pale residue shows both in the header or footer and on the diagonal, and the diagonal's share."""
    shape = page.shape[:2]
    g = K.gray(page)
    pale = (g >= s.gray_low) & (g <= s.gray_high) & (R.saturation(page) <= s.saturation) & ~R.text_guard(page, s)
    frame = (pale & (R.box_mask(shape, s.header_box) | R.box_mask(shape, s.footer_box))).mean()
    diagonal = float((pale & R.band_mask(shape, s)).mean())
    return bool(frame >= least and diagonal >= least), diagonal


def probe(pages: list[np.ndarray]) -> float:
    """Confidence that the first and the last page share a known overlay; one page of two is at most a weak sign."""
    hits = [probe_page(normalise(p)) for p in (pages if len(pages) < 2 else [pages[0], pages[-1]])]
    good = [d for hit, d in hits if hit]
    if not good:
        return 0.0
    confidence = min(0.98, 0.70 + 0.20 * len(good) / len(hits) + 0.08 * min(1.0, float(np.mean(good)) / 0.02))
    return confidence if len(good) == len(hits) else min(0.84, confidence)


def add_probe(candidates: DataFrame, profiles: DataFrame, probes: DataFrame, marker: str, least: float = 0.70) -> DataFrame:
    """Candidates with a raster candidate for image documents that have none of this marker.

    ``probes``: document, confidence, n_pages.
    """
    has = candidates.where(F.col("marker") == marker).select("document").distinct()
    eligible = profiles.where((F.col("kind") == "raster") & (F.col("full_page_image_ratio") >= 0.8)).select("document").join(has, "document", "left_anti")
    new = probes.join(eligible, "document").where((F.col("confidence") >= least) & (F.col("n_pages") > 0))
    return candidates.unionByName(new.select("document", F.lit(marker).alias("marker"), "n_pages", F.lit(False).alias("repeated"), "confidence"))


def coverage(placements: DataFrame) -> DataFrame:
    """document, page_id, coverage: the largest share of the page that one image covers; 0 for an empty page."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("area"), F.col("page_area")), F.lit(0.0)))
    return placements.groupBy("document", "page_id").agg(F.max(share).alias("coverage"))


def unsafe_pages(pages: DataFrame, known_hosts: tuple[str, ...] = ()) -> DataFrame:
    """document, page_id, reason of pages that may not be rebuilt: rotated, annotated, linked elsewhere, with text, or not one image.

    ``pages``: document, page_id, rotation, n_annotations, links (array), n_chars, coverage.
    """
    foreign = F.exists("links", lambda u: ~known_link(u, known_hosts))
    reason = (
        F.when(F.col("rotation") != 0, "rotation").when(F.col("n_annotations") > 0, "annotations").when(foreign, "links").when(F.col("n_chars") > 0, "text").when(F.col("coverage") < 0.95, "image")
    )
    return pages.select("document", "page_id", reason.alias("reason")).where("reason is not null")


def known_link(uri: Column, hosts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hosts:
        out = out | F.lower(uri).contains(h.lower())
    return out


def missing_from(new: DataFrame, cache: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Documents whose fingerprint has no stored profile."""
    return new.join(cache.select(key), key, "left_anti")


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, n_rows of the conditions that rows break; nulls break none."""
    counts = rows.agg(*[F.count(F.when(~F.expr(c), 1)).alias(n) for n, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules]))
    return counts.select(pairs.alias("r")).select("r.rule", "r.n_rows").where("n_rows > 0")


def clean_native(page: np.ndarray, points: tuple[float, float], s: R.Settings = R.Settings(), dpi: int = 150) -> tuple[np.ndarray, dict]:
    """Clean a native image at work size and transfer only what the pass changed; the footer is polished at native size.

    Everything outside the trusted mask stays byte for byte.
    """
    page = normalise(page)
    h, w = page.shape[:2]
    wh, ww = work_size((h, w), points, dpi)
    small = np.rint(K.resize(page, wh, ww, "area")).astype(np.uint8)
    cleaned, meta = R.clean(small, s)
    trusted = K.resize(I.change_mask(small, cleaned), h, w)
    large = np.clip(np.rint(K.resize(cleaned, h, w, "cubic")), 0, 255).astype(np.uint8)
    out = I.assemble(page, large, trusted & ~K.dark_guard(page))
    out, polished = footer.polish(out)
    return out, meta | {"changed": float(K.differs(out, page).mean()), "level": polished["level"], "footer_score": polished["score"], "protected_change": polished["protected_change"], "residual": residual(page, out, trusted, K.paper(K.gray(page).astype(float)))}


def residual(before: np.ndarray, after: np.ndarray, mask: np.ndarray, background: np.ndarray, least: int = 3) -> float:
    """Remaining over original contrast to the paper (``background``, gray) of the acted pixels of a mask; 1 if nothing was done, 0 without a
    mask.  A pixel was acted on if a channel changed by ``least``."""
    acted = mask & K.differs(before, after, least - 1)
    if not acted.any():
        return 1.0 if mask.any() else 0.0
    back, a, b = (v.astype(int)[acted] for v in (background, K.gray(before), K.gray(after)))
    was = np.clip(back - a, 0, 255).sum()
    return float(np.clip(np.clip(back - b, 0, 255).sum() / was, 0, 1)) if was else 0.0


def contrast_mask(page: np.ndarray) -> np.ndarray:
    """Dark pixels with local contrast or on an edge."""
    g = K.gray(page)
    return (g <= 125) & ((K.gaussian_blur(g, 9) - g >= 35) | K.dilate(R.edges(g)))


def page_metrics(before: np.ndarray, after: np.ndarray) -> dict:
    """Losses of dark and of contrasted content, and the mean change, of one page; sizes must agree."""
    if before.shape != after.shape:
        return {"ok": False, "dark_loss": 1.0, "contrast_loss": 1.0, "mean_change": 255.0}
    a, b = K.gray(before).astype(int), K.gray(after).astype(int)
    dark, sharp = a < 90, contrast_mask(before)
    lost = b - a > 45
    dark_loss, contrast_loss = float((lost & dark).sum() / max(1, dark.sum())), float((lost & sharp).sum() / max(1, sharp.sum()))
    return {"ok": dark_loss <= 0.02 and contrast_loss <= 0.05, "dark_loss": dark_loss, "contrast_loss": contrast_loss, "mean_change": float(abs(a - b).mean())}


def sample_native(pages: list[np.ndarray], most: int = 8, side: int = 900) -> list[np.ndarray]:
    """At most ``most`` evenly spread pages, their longer side at most ``side``."""
    n = min(most, len(pages))
    picks = range(len(pages)) if n == len(pages) else [0] if n == 1 else [round(i * (len(pages) - 1) / (n - 1)) for i in range(n)]
    out = []
    for i in picks:
        g = K.gray(pages[i])
        scale = min(1.0, side / max(g.shape))
        out.append(g if scale == 1 else np.rint(K.resize(g, max(1, int(g.shape[0] * scale)), max(1, int(g.shape[1] * scale)), "area")).astype(np.uint8))
    return out
