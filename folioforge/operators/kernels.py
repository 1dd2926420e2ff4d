"""Pixel kernels for pages of any shape, and their distribution over pages.

A page is a row (document, page_id, height, width, channels, data) with its pixels as bytes.  Kernels are NumPy; a page is
the unit of work, so a document of any length spreads over all tasks and no task holds more than an Arrow batch of pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import sampling

PAGE = "document string, page_id long, height int, width int, channels int, data binary"


def gray(page: np.ndarray) -> np.ndarray:
    """Luma of an RGB or RGBA page, rounded; a gray page as it is."""
    if page.ndim == 2:
        return page
    if page.ndim != 3 or page.shape[2] < 3:
        raise ValueError(f"unsupported page shape {page.shape}")
    return np.rint(page[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def extremes(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest channel of each pixel."""
    low = high = page[..., 0]
    for c in range(1, page.shape[2]):
        low, high = np.minimum(low, page[..., c]), np.maximum(high, page[..., c])
    return low, high


def differs(a: np.ndarray, b: np.ndarray, by: int = 0) -> np.ndarray:
    """Pixels of two ``uint8`` pages of which a channel differs by more than ``by``."""
    if a.ndim == 2:
        a, b = a[..., None], b[..., None]
    out = np.zeros(a.shape[:2], bool)
    for c in range(a.shape[2]):
        out |= abs(a[..., c].astype(np.int16) - b[..., c]) > by if by else a[..., c] != b[..., c]
    return out


def _windows(a: np.ndarray, height: int, width: int, pad) -> np.ndarray:
    top, left = height // 2, width // 2
    padded = np.pad(a, ((top, height - 1 - top), (left, width - 1 - left)), mode="constant", constant_values=pad) if pad != "edge" else np.pad(a, ((top, height - 1 - top), (left, width - 1 - left)), mode="edge")
    return sliding_window_view(padded, (height, width))


def _spread(mask: np.ndarray, size: int, axis: int, every: bool) -> np.ndarray:
    """Whether any, or every, pixel of each window along an axis is set.  Windows double until they are long enough, so the cost follows the
    logarithm of the window; beyond the edges of the page lies what changes nothing."""
    if size == 1:
        return mask
    before = size // 2
    shape, at = list(mask.shape), [slice(None), slice(None)]
    shape[axis] += size - 1
    at[axis] = slice(before, before + mask.shape[axis])
    out = np.full(shape, every)
    out[tuple(at)] = mask
    join, done = np.logical_and if every else np.logical_or, 1
    while done < size:
        step = min(done, size - done)
        out = join(out[:-step], out[step:]) if axis == 0 else join(out[:, :-step], out[:, step:])
        done += step
    return out


def dilate(mask: np.ndarray, height: int = 3, width: int = 3) -> np.ndarray:
    """Separable: a rectangle is a column after a row."""
    return _spread(_spread(mask, width, 1, False), height, 0, False) if mask.any() else mask.copy()


def erode(mask: np.ndarray, height: int = 3, width: int = 3) -> np.ndarray:
    return _spread(_spread(mask, width, 1, True), height, 0, True) if mask.any() else mask.copy()


def close(mask: np.ndarray, height: int = 3, width: int = 3) -> np.ndarray:
    return erode(dilate(mask, height, width), height, width)


def opened(mask: np.ndarray, height: int = 3, width: int = 3) -> np.ndarray:
    return dilate(erode(mask, height, width), height, width)


def median_blur(a: np.ndarray, size: int = 5) -> np.ndarray:
    return np.median(_windows(a, size, size, "edge"), axis=(2, 3)).astype(a.dtype)


#: Exchanges that bring the middle one of seven values to place 3.
_MIDDLE = ((0, 5), (0, 3), (1, 6), (2, 4), (0, 1), (3, 5), (2, 6), (2, 3), (3, 6), (4, 5), (1, 4), (1, 3), (3, 4))


def column_median(a: np.ndarray) -> np.ndarray:
    """Median of each pixel and the three above and below it; edges repeated."""
    padded = np.pad(a, ((3, 3), (0, 0)), mode="edge")
    rows = [padded[i : i + len(a)] for i in range(7)]
    for i, j in _MIDDLE:
        rows[i], rows[j] = np.minimum(rows[i], rows[j]), np.maximum(rows[i], rows[j])
    return rows[3]


def gaussian_blur(a: np.ndarray, size: int, width: int | None = None) -> np.ndarray:
    """Separable Gaussian with the usual sigma for a kernel of ``size`` rows and as many, or ``width``, columns; beyond its edges the page is mirrored, the edge itself once.

    The last two axes are rows and columns; others hold channels."""
    out = a.astype(float)
    for axis, n in ((a.ndim - 2, size | 1), (a.ndim - 1, (width or size) | 1)):
        sigma = 0.3 * ((n - 1) * 0.5 - 1) + 0.8
        x = np.arange(n) - n // 2
        k = np.exp(-(x**2) / (2 * sigma**2))
        pad = [(0, 0)] * a.ndim
        pad[axis] = (n // 2, n // 2)
        out = sliding_window_view(np.pad(out, pad, mode="reflect" if a.shape[axis] > 1 else "edge"), n, axis=axis) @ (k / k.sum())
    return out


def resize(a: np.ndarray, height: int, width: int, how: str = "nearest") -> np.ndarray:
    """Nearest, area (means of whole source blocks), linear or cubic resize of a 2-D array; all but linear also of the channels of a page at once."""
    h, w = a.shape[:2]
    if how == "nearest":
        return a[np.minimum((np.arange(height) * h / height).astype(int), h - 1)][:, np.minimum((np.arange(width) * w / width).astype(int), w - 1)]
    if how == "area":
        ys, xs = np.linspace(0, h, height + 1).astype(int), np.linspace(0, w, width + 1).astype(int)
        sums = np.add.reduceat(np.add.reduceat(a.astype(float), ys[:-1], 0), xs[:-1], 1)
        areas = np.outer(np.maximum(np.diff(ys), 1), np.maximum(np.diff(xs), 1))
        return sums / (areas if a.ndim == 2 else areas[..., None])
    if how == "cubic":
        rows = _cubic(a.astype(float).reshape(h, -1), height).reshape(height, *a.shape[1:])
        columns = _cubic(rows.swapaxes(0, 1).reshape(w, -1), width)
        return columns.reshape(width, height, *a.shape[2:]).swapaxes(0, 1)
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    f = a.astype(float)
    return (f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy


#: Fixed value: the sharpness of the cubic kernel.
CUBIC = -0.75


def _cubic(a: np.ndarray, size: int) -> np.ndarray:
    """Cubic convolution (Keys, 1981) along the first axis; edges repeated."""
    at = (np.arange(size) + 0.5) * len(a) / size - 0.5
    first = np.floor(at).astype(int) - 1
    out = np.zeros((size, a.shape[1]))
    for i in range(4):
        d = abs(at - (first + i))
        weight = np.where(d <= 1, ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1, ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC)
        out += weight[:, None] * a[np.clip(first + i, 0, len(a) - 1)]
    return out


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 is background) of 8-connected components, and rows (x, y, width, height, area) by label.

    All runs of the rows are cut out at once and united with the runs they touch in the row above, so work follows runs, not rows or pixels.
    """
    h, w = mask.shape
    if not mask.any():
        return np.zeros((h, w), np.int32), np.zeros((0, 5), np.int64)
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = np.flatnonzero(np.diff(padded.ravel()))  # places in rows of w + 2
    first, last = edges[::2], edges[1::2]
    # touching includes corners: the first run above that does not end before this one, and those that begin before its end
    low = np.searchsorted(last, first - (w + 2))
    high = np.searchsorted(first, last - (w + 2), "right")
    n_touched = np.maximum(high - low, 0)
    parent = np.where(n_touched > 0, low, np.arange(len(first)))
    below = np.repeat(np.arange(len(first)), n_touched)
    above = np.arange(len(below)) - np.repeat(np.cumsum(n_touched) - n_touched - low, n_touched)
    more = above != parent[below]
    if more.any():
        up = parent.tolist()

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, j in zip(below[more].tolist(), above[more].tolist()):
            i, j = find(i), find(j)
            if i != j:
                up[max(i, j)] = min(i, j)
        parent = np.array(up)
    while (jump := parent[parent]).tolist() != parent.tolist():
        parent = jump
    _, own = np.unique(parent, return_inverse=True)
    labels = np.zeros((h, w), np.int64)
    labels[mask] = np.repeat(own + 1, last - first)
    y, n = first // (w + 2), int(own.max()) + 1
    out = np.zeros((n, 5), np.int64)
    out[:, 4] = np.bincount(own, weights=last - first, minlength=n)
    for col, a, b in ((0, first - y * (w + 2), last - y * (w + 2)), (1, y, y + 1)):
        begin, end = np.full(n, 1 << 40), np.zeros(n, np.int64)
        np.minimum.at(begin, own, a)
        np.maximum.at(end, own, b)
        out[:, col], out[:, col + 2] = begin, end - begin
    return labels, out


def in_box(stats: np.ndarray, k: int) -> tuple[slice, slice]:
    """Rows and columns of component ``k``."""
    x, y, w, h = stats[k - 1, :4].tolist()
    return slice(y, y + h), slice(x, x + w)


def median_color(pixels: np.ndarray) -> np.ndarray:
    """Median of each channel of ``uint8`` pixels (n, channels), by counting."""
    n = len(pixels)
    out = np.empty(pixels.shape[1])
    for c in range(pixels.shape[1]):
        upto = np.bincount(pixels[:, c], minlength=256).cumsum()
        out[c] = upto.searchsorted([(n - 1) // 2, n // 2], "right").mean()
    return out


def keep_components(mask: np.ndarray, least_area: int = 1, least_span: int = 1, most_share: float = 1.0) -> np.ndarray:
    """The mask without components that are too small, too short or too large a part of the page."""
    labels, stats = components(mask)
    good = (stats[:, 4] >= least_area) & (stats[:, 2:4].max(1, initial=0) >= least_span) & (stats[:, 4] <= most_share * mask.size) if len(stats) else np.zeros(0, bool)
    return np.concatenate([[False], good])[labels]


def merge_rects(rects: list[tuple[int, int, int, int]], gap: int = 0) -> list[tuple[int, int, int, int]]:
    """Unite boxes (x0, y0, x1, y1) at most ``gap`` apart until none are; sorted."""
    todo, done = sorted(rects), []
    while todo:
        x0, y0, x1, y1 = todo.pop()
        near = [r for r in todo + done if r[0] <= x1 + gap and x0 <= r[2] + gap and r[1] <= y1 + gap and y0 <= r[3] + gap]
        if near:
            todo = [r for r in todo if r not in near]
            done = [r for r in done if r not in near]
            todo.append((min(x0, *(r[0] for r in near)), min(y0, *(r[1] for r in near)), max(x1, *(r[2] for r in near)), max(y1, *(r[3] for r in near))))
        else:
            done.append((x0, y0, x1, y1))
    return sorted(set(done))


def segment_band(shape: tuple[int, int], x0: float, y0: float, x1: float, y1: float, width: float) -> np.ndarray:
    """Pixels at most ``width`` from a segment."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
    return np.hypot(x - x0 - t * dx, y - y0 - t * dy) <= width


#: What a pixel of a shared overlay is like, and the kernels over which paper is estimated.
OVERLAY = {"most_mad": 5.5, "low": 125, "high": 246, "contrast": 4}
LEARN_SHARE, REPAIR_SHARE, LEAST_KERNEL, MOST_KERNEL, WORK_SIDE = 0.10, 0.08, 15, 81, 900


def odd(size: float, share: float) -> int:
    """An odd kernel size: a share of the page, LEAST_KERNEL at least."""
    return max(LEAST_KERNEL, int(round(size * share))) | 1


def learn(samples: list[np.ndarray], most_mad: float = 5.5, low: float = 125, high: float = 246, contrast: float = 4, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Mask, template and confidence of an overlay that several pages share; ``where`` limits it to a part of the page.

    The pixels that vary little and are darker than the paper around them, closed and grown by one, are the mask; its share of the
    page and the variation within it make the confidence.
    """
    if len(samples) < 2:
        raise ValueError("a model needs two pages")
    shape = samples[0].shape[:2]
    stack = np.stack([g if (g := gray(s)).shape == shape else resize(g, *shape, "area") for s in samples]).astype(np.float32)
    med = np.median(stack, axis=0)
    mad = np.median(abs(stack - med), axis=0)
    back = gaussian_blur(med, odd(min(shape), LEARN_SHARE))
    core = (mad <= most_mad) & (med >= low) & (med <= high) & (back - med >= contrast)
    mask = dilate(close(core & where if where is not None else core))
    if not mask.any():
        return mask, med, 0.0
    stable = float(np.clip(1 - mad[mask].mean() / 12, 0, 1))
    return mask, med, float(np.clip(0.55 + 0.30 * stable + 0.15 * min(1.0, mask.mean() / 0.02), 0, 0.98))


def dark_guard(page: np.ndarray, limit: int = 105) -> np.ndarray:
    return dilate(gray(page) <= limit)


def paper(g: np.ndarray) -> np.ndarray:
    """The local background of a gray page: a wide blur of the page at WORK_SIDE pixels at most, scaled up again."""
    h, w = g.shape
    scale = min(1.0, WORK_SIDE / max(h, w))
    small = g if scale == 1 else resize(g, max(1, round(h * scale)), max(1, round(w * scale)), "area")
    blurred = gaussian_blur(small, min(MOST_KERNEL, odd(min(small.shape), REPAIR_SHARE)))
    return blurred if scale == 1 else resize(blurred, h, w, "linear")


def repair(page: np.ndarray, mask: np.ndarray, gain: int = 24) -> tuple[np.ndarray, int]:
    """Lift masked pixels to the local background, or by ``gain`` at least; dark content and a pixel around it stay byte for byte.
    Returns the page and the number of changed pixels."""
    act = mask & ~dark_guard(page)
    if not act.any():
        return page.copy(), 0
    g = gray(page).astype(float)
    rise = np.clip(np.maximum(paper(g)[act] + 4, g[act] + gain), 0, 255) - g[act]
    out = page.copy()
    out[act] = np.clip(page[act] + (rise if page.ndim == 2 else rise[:, None]), 0, 255).astype(np.uint8)
    return out, int((out != page).reshape(*g.shape, -1).any(-1).sum())


def whiten_edges(page: np.ndarray, top: int, bottom: int) -> np.ndarray:
    out = page.copy()
    out[:top] = 255
    if bottom:
        out[-bottom:] = 255
    return out


def clean_page(page: np.ndarray, mask: np.ndarray, top: int = 0, bottom: int = 0) -> tuple[np.ndarray, dict]:
    """The ordered page pass: edges, overlay, footer.  Returns the page and its metrics."""
    from . import footer

    out = whiten_edges(page, top, bottom)
    out, changed = repair(out, mask)
    out, polished = footer.polish(out)
    return out, {"changed_pixels": changed, "level": polished["level"], "footer_score": round(polished["score"], 6)}


def _middle(values: np.ndarray) -> float:
    v = np.sort(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@lru_cache(8)
def _grids(n: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spacing and phase of every grid on ``n`` rows, in order, and for each spacing the grid that each row is on."""
    spacings = np.arange(least, most + 1)
    starts = np.cumsum(spacings) - spacings
    phase = np.arange(spacings.sum()) - np.repeat(starts, spacings)
    out = np.repeat(spacings, spacings), phase, starts[:, None] + np.arange(n) % spacings[:, None]
    for a in out:
        a.setflags(write=False)
    return out


def ruled_grid(row_means: np.ndarray, least: int = 3, most: int = 60) -> tuple[int, int, float]:
    """(spacing, phase, score) of the regular dark rows that explain a page's row means best, and most of them.

    All grids are summed at once."""
    n, half = len(row_means), 7
    edge = [_middle(row_means[max(0, i - half) : i + half + 1]) for i in range(n) if i < half or i >= n - half]
    base = np.array(edge, float)
    if n > 2 * half:
        base = np.concatenate([base[:half], np.median(sliding_window_view(row_means, 2 * half + 1), axis=1), base[half:]])
    score = np.maximum(base - row_means, 0)
    best = (0, 0, 0.0)
    most = min(most, n // 2)
    if most < least:
        return best
    spacing, phase, on = _grids(n, least, most)
    sums = np.bincount(on.ravel(), np.broadcast_to(score, on.shape).ravel(), len(spacing))
    counts = (n - phase + spacing - 1) // spacing
    value = (sums / counts - score.mean()) * np.minimum(1.0, counts / 4) * (sums / max(score.sum(), 1e-9))
    records = np.flatnonzero(value > np.concatenate([[0.0], np.maximum.accumulate(value)[:-1]]))
    for i in records.tolist():
        if value[i] > best[2] + 1e-12:
            best = (int(spacing[i]), int(phase[i]), float(value[i]))
    return best


def _footer(page: np.ndarray) -> np.ndarray:
    from . import footer

    return footer.polish(page)[0]


KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda page: page,
    "footer": lambda page: _footer(page),
    "median": lambda page: median_blur(page) if page.ndim == 2 else np.stack([median_blur(page[..., c]) for c in range(page.shape[2])], -1),
}


def register(name: str, kernel: Callable[[np.ndarray], np.ndarray]) -> None:
    """Add a page processor: a function of one page that returns a page of the same shape."""
    KERNELS[name] = kernel


def to_rows(pages: list[tuple[str, int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(
        [(d, i, p.shape[0], p.shape[1], p.shape[2] if p.ndim == 3 else 1, np.ascontiguousarray(p).tobytes()) for d, i, p in pages],
        columns=["document", "page_id", "height", "width", "channels", "data"],
    )


def to_page(row) -> np.ndarray:
    shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
    return np.frombuffer(row.data, np.uint8).reshape(shape)


def process(pages: DataFrame, name: str) -> DataFrame:
    """Run a page processor over all pages: the page columns and ``error``.  A page whose processor fails stays as it is."""
    if name not in KERNELS:
        raise ValueError(f"unknown processor {name!r}")
    kernel = KERNELS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, errors = [], []
            for row in batch.itertuples():
                try:
                    out = kernel(to_page(row))
                    data.append(np.ascontiguousarray(out).tobytes())
                    errors.append(None)
                except Exception as e:  # the original page is the fallback
                    data.append(row.data)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield batch.assign(data=data, error=errors)

    return pages.select("document", "page_id", "height", "width", "channels", "data").mapInPandas(run, PAGE + ", error string")


def apply_models(pages: DataFrame, models: DataFrame) -> DataFrame:
    """Clean every page with its document's mask (models: document, mask as page-sized bytes): pages and metrics.

    Models are joined by document, so their number may grow with the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                page = to_page(row)
                mask = np.frombuffer(row.mask, np.uint8).reshape(row.height, row.width) > 0 if row.mask is not None else np.zeros((row.height, row.width), bool)
                out, metrics = clean_page(page, mask)
                rows.append((row.document, row.page_id, row.height, row.width, row.channels, out.tobytes(), metrics["changed_pixels"], metrics["level"], metrics["footer_score"]))
            yield pd.DataFrame(rows, columns=["document", "page_id", "height", "width", "channels", "data", "changed_pixels", "level", "footer_score"])

    joined = pages.join(models.select("document", "mask"), "document", "left")
    return joined.mapInPandas(run, PAGE + ", changed_pixels long, level string, footer_score double")


def learn_models(pages: DataFrame, most_samples: int = 8) -> DataFrame:
    """document, n_samples, mask, confidence from at most ``most_samples`` evenly spread pages of each document.

    Page numbers are worked out first, on ids alone; only the picked pages are shuffled, so a task holds ``most_samples`` pages
    at most, whatever a document's length.
    """
    ids = pages.select("document", F.col("page_id").alias("doc_id"))
    counts = ids.groupBy("document").agg(F.count("*").cast("int").alias("n"))
    at = counts.select("document", F.explode(sampling.even(F.col("n"), most_samples)).alias("page_index"))
    picked = tables.numbered(ids).join(at, ["document", "page_index"]).select("document", F.col("doc_id").alias("page_id"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        samples = [to_page(r) for r in rows.sort_values("page_id").itertuples()]
        if len(samples) < 2:
            return pd.DataFrame({"document": [], "n_samples": [], "mask": [], "confidence": []})
        mask, _, confidence = learn(samples)
        return pd.DataFrame({"document": [rows.document.iloc[0]], "n_samples": [len(samples)], "mask": [mask.astype(np.uint8).tobytes()], "confidence": [confidence]})

    return pages.join(picked, ["document", "page_id"]).groupBy("document").applyInPandas(run, "document string, n_samples long, mask binary, confidence double")
