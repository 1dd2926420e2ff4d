"""Kernels for photographed and illustrated pages, and the assembly of cleaned pages from patches.

``clean`` keeps what is certainly ink, illustration or graph and whitens a neutral overlay; hybrid assembly compares a page with its
cleaned version and decides between patches and a whole new page.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import kernels as K
from .ruledpages import edges, saturation, straight_strokes


def otsu(values: np.ndarray) -> int:
    """Threshold with the largest between-class variance."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 0)
    return int(between.argmax())


def value_masks(page: np.ndarray, low_saturation: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dark, light, and light pixels of little saturation, by Otsu's threshold of the brightest channel."""
    v = page.max(2)
    dark = v <= otsu(v)
    return dark, ~dark, ~dark & (saturation(page) <= low_saturation)


def illustrations(page: np.ndarray, least: float = 0.008, most: float = 0.7, width: int = 80, height: int = 60) -> np.ndarray:
    """Boxes of large connected ink: pictures, not text."""
    ink = K.dilate(value_masks(page)[0], 5, 5)
    out = np.zeros(page.shape[:2], bool)
    for x, y, w, h, _ in K.components(ink)[1].tolist():
        if w >= width and h >= height and least <= w * h / out.size <= most:
            out[y : y + h, x : x + w] = True
    return out


def touching(mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Components of ``mask`` that touch ``seed``."""
    labels, stats = K.components(mask)
    hit = np.zeros(len(stats) + 1, bool)
    hit[np.unique(labels[seed & mask])] = True
    hit[0] = False
    return hit[labels]


def line_like(mask: np.ndarray, aspect: float = 6.0, least: int = 12) -> np.ndarray:
    """Long thin components."""
    labels, stats = K.components(mask)
    if not len(stats):
        return np.zeros(mask.shape, bool)
    w, h = stats[:, 2], stats[:, 3]
    good = (np.maximum(w, h) >= least) & (np.maximum(w, h) >= aspect * np.minimum(w, h))
    return np.concatenate([[False], good])[labels]


def blue_ink(page: np.ndarray) -> np.ndarray:
    p = page.astype(int)
    return (p[..., 2] - p[..., 0] > 35) & (p[..., 2] - p[..., 1] > 10) & (K.gray(page) < 215)


def graph_roi(page: np.ndarray, span: int = 31, least_ink: int = 60, least_crossings: int = 2) -> np.ndarray:
    """Box of a graph: blue ink with axes that cross."""
    blue = blue_ink(page)
    out = np.zeros(blue.shape, bool)
    if blue.sum() < least_ink:
        return out
    dark = K.gray(page) <= 200
    across, down = K.opened(dark, 1, span), K.opened(dark, span, 1)
    if len(K.components(K.dilate(across) & K.dilate(down))[1]) < least_crossings and not (across.any() and down.any()):
        return out
    ys, xs = np.nonzero(blue | across | down)
    out[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
    return out


def graph_preserve(page: np.ndarray, roi: np.ndarray, span: int = 31) -> np.ndarray:
    """Faint axes and grid strokes, blue ink and dark pixels inside the graph's box, dilated."""
    faint = straight_strokes(K.gray(page) <= 235, span)
    return K.dilate((faint | blue_ink(page) | (K.gray(page) <= 120)) & roi)


def neutral_overlay(page: np.ndarray, keep: np.ndarray, low: int = 140, high: int = 250, most_saturation: int = 28) -> np.ndarray:
    """Gray pixels that are no guarded content; the guards hold again after the mask grew."""
    g = K.gray(page)
    mask = (g >= low) & (g <= high) & (saturation(page) <= most_saturation) & ~keep
    return K.dilate(mask) & ~keep & (g >= low)


@dataclass(frozen=True)
class InkSettings:
    illustrations: bool = True
    graphs: bool = True
    aggressive: bool = False
    grayscale: bool = False
    border_top: int = 0
    border_bottom: int = 0


def clean(page: np.ndarray, s: InkSettings = InkSettings()) -> tuple[np.ndarray, dict]:
    """Protect ink, graphs and illustrations; whiten the neutral overlay, or with ``aggressive`` everything unprotected."""
    dark, _, _ = value_masks(page)
    ink = K.dilate(dark & (K.gray(page) <= 170)) | (saturation(page) > 45) | (edges(K.gray(page)) & K.dilate(K.gray(page) <= 140))
    roi = graph_roi(page) if s.graphs else np.zeros(dark.shape, bool)
    keep = ink | (graph_preserve(page, roi) if s.graphs else roi)
    if s.illustrations:
        keep |= illustrations(page)
    mask = ~keep if s.aggressive else neutral_overlay(page, keep)
    out = page.copy()
    out[mask] = 255
    if s.grayscale:
        out = np.repeat(K.gray(out)[..., None], 3, 2)
    return K.whiten_edges(out, s.border_top, s.border_bottom), {"removed": int(mask.sum()), "protected": int(keep.sum()), "graph": bool(roi.any())}


K.register("ink", lambda page: clean(page)[0])


# ---- hybrid assembly
def change_mask(before: np.ndarray, after: np.ndarray, gray_step: int = 4, channel_step: int = 6, forced: np.ndarray | None = None) -> np.ndarray:
    """Pixels that cleaning changed, closed and dilated; ``forced`` ones count as changed."""
    a, b = K.gray(before).astype(int), K.gray(after).astype(int)
    mask = (abs(a - b) >= gray_step) | K.differs(before, after, channel_step - 1)
    if forced is not None:
        mask |= forced
    return K.dilate(K.close(mask))


def patch_boxes(mask: np.ndarray, pad: int = 2, gap: int = 6, most: int = 120) -> list[tuple[int, int, int, int]]:
    """Merged boxes of the changed components; more than ``most`` is reported by a longer list, never cut."""
    h, w = mask.shape
    boxes = [(max(0, x - pad), max(0, y - pad), min(w, x + bw + pad), min(h, y + bh + pad)) for x, y, bw, bh, _ in K.components(mask)[1].tolist()]
    boxes = K.merge_rects(boxes, gap)
    while len(boxes) > most and gap < max(h, w):
        gap *= 2
        boxes = K.merge_rects(boxes, gap)
    return boxes


def seam_risk(boxes: list[tuple[int, int, int, int]], shape: tuple[int, int]) -> bool:
    """Whether a patch is so large that its border would show."""
    h, w = shape
    return any((x1 - x0) * (y1 - y0) >= 0.12 * h * w and x1 - x0 >= 0.45 * w and y1 - y0 >= 0.25 * h for x0, y0, x1, y1 in boxes)


def choose_mode(mask: np.ndarray, boxes: list[tuple[int, int, int, int]], watch_seams: bool = False) -> str:
    """Patches, or a whole new page."""
    coverage = sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes) / mask.size
    whole = mask.mean() > 0.42 or coverage > 0.62 or len(boxes) > 120 or (watch_seams and seam_risk(boxes, mask.shape))
    return "full_raster" if whole else "hybrid"


def png(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG of a gray, RGB or RGBA page."""
    h, w = pixels.shape[:2]
    channels = pixels.shape[2] if pixels.ndim == 3 else 1
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * channels)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, min(9, max(0, level)))) + chunk(b"IEND", b"")


def patch_png(after: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], how: str = "hard") -> bytes:
    """A patch as RGBA: opaque, cut at the mask, or feathered at its border."""
    x0, y0, x1, y1 = box
    own = mask[y0:y1, x0:x1]
    alpha = {"opaque": np.full(own.shape, 255.0), "hard": own * 255.0}.get(how)
    if alpha is None:
        if how != "feather":
            raise ValueError(f"unknown patch border {how!r}")
        alpha = K.gaussian_blur(own * 255.0, 5)
    return png(np.concatenate([after[y0:y1, x0:x1], np.rint(alpha).astype(np.uint8)[..., None]], 2))


def horizontal_lines(mask: np.ndarray, least: int = 30, thick: int = 4) -> list[tuple[int, int, int, int]]:
    """Thin long components as segments (x0, y, x1, thickness)."""
    return sorted((x, y + h // 2, x + w, h) for x, y, w, h, _ in K.components(mask)[1].tolist() if w >= least and h <= thick)


def to_points(box: tuple[float, float, float, float], image: tuple[int, int], page: tuple[float, float], origin: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float, float]:
    """A box in pixels of an image (height, width) as points of a page (width, height) with an origin."""
    sx, sy = page[0] / image[1], page[1] / image[0]
    return (origin[0] + box[0] * sx, origin[1] + box[1] * sy, origin[0] + box[2] * sx, origin[1] + box[3] * sy)


def page_result(before: np.ndarray, clean_page, watch_seams: bool = False) -> dict:
    """Mode, patches and figures of a page; if cleaning fails, the page as it was and the error."""
    try:
        after = clean_page(before)
        mask = change_mask(before, after)
        boxes = patch_boxes(mask)
        mode = choose_mode(mask, boxes, watch_seams)
        patches = [(b, patch_png(after, mask, b)) for b in boxes] if mode == "hybrid" else [((0, 0, before.shape[1], before.shape[0]), png(after))]
        return {"mode": mode, "patches": patches, "lines": horizontal_lines(mask), "changed": float(mask.mean()), "fallback": False, "error": None}
    except Exception as e:
        return {"mode": "full_raster", "patches": [((0, 0, before.shape[1], before.shape[0]), png(before))], "lines": [], "changed": 0.0, "fallback": True, "error": f"{type(e).__name__}: {e}"}


def assemble(before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Trusted transfer: changed pixels from ``after``, all others byte for byte from ``before``."""
    return np.where(mask[..., None] if before.ndim == 3 else mask, after, before)
