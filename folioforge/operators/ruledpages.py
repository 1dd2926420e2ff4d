"""Kernels for ruled and tabular pages: masks over pixels of one RGB page, and the ordered pass over them.

All functions take ``uint8`` pages (height, width, 3) or masks of the same size and return new arrays; thresholds are in
``Settings``.  ``clean`` is the page pass: its order matters, as later steps protect and restore what earlier ones touched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache, wraps

import numpy as np

from . import kernels as K


@dataclass(frozen=True)
class Settings:
    """Tunables of the page pass; boxes and widths are parts of the page."""

    header_box: tuple[float, float, float, float] = (0.25, 0.0, 0.75, 0.05)
    footer_box: tuple[float, float, float, float] = (0.25, 0.95, 0.75, 1.0)
    header_right: tuple[float, float, float, float] = (0.72, 0.0, 1.0, 0.08)
    gray_low: int = 150
    gray_high: int = 252
    saturation: int = 30
    dark: int = 110
    local_contrast: int = 28
    band: tuple[float, float, float, float] = (0.1, 0.95, 0.95, 0.1)
    band_width: float = 0.06
    halo: int = 2
    panel_saturation: int = 18
    panel_area: float = 0.01
    panel_fill: float = 0.6
    rule_contrast: float = 4.0
    rule_cover: float = 0.18
    rule_confidence: float = 0.54
    gap: int = 9
    panel_gate: int = 120
    speck: int = 3
    stroke_span: int = 25
    blend: float = 1.0
    full_page: bool = False


#: What the speed presets change.
PRESETS = {"quality": {}, "balanced": {"halo": 1, "gap": 5, "stroke_span": 31}}


def preset(name: str, base: Settings = Settings()) -> Settings:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return replace(base, **PRESETS[name])


def from_mapping(values: dict, base: Settings = Settings()) -> Settings:
    """Known keys of a configuration; unknown ones are ignored."""
    return replace(base, **{k: v for k, v in values.items() if k in Settings.__dataclass_fields__})


# ---- what the steps ask of a page
class Facts:
    """A page whose measures are worked out once, however many steps ask for them; neither may be changed meanwhile."""

    def __init__(self, page: np.ndarray):
        self.page, self.shape, self.known = page, page.shape[:2], {}

    @cached_property
    def gray(self) -> np.ndarray:
        return K.gray(self.page)

    @cached_property
    def brightest(self) -> np.ndarray:
        return K.extremes(self.page)[1]

    @cached_property
    def saturation(self) -> np.ndarray:
        return saturation(self.page)


def fact(f: Callable) -> Callable:
    """Let a measure of one page take the page or its ``Facts``, which remember it."""

    @wraps(f)
    def measure(page: np.ndarray | Facts, *args):
        if not isinstance(page, Facts):
            return f(Facts(page), *args)
        key = (f.__name__, *args)
        if key not in page.known:
            page.known[key] = f(page, *args)
        return page.known[key]

    return measure


def facts(page: np.ndarray | Facts, like: Facts | None = None) -> Facts:
    """The facts of a page; those of ``like`` if that page is equal."""
    if isinstance(page, Facts):
        return page
    return like if like is not None and np.array_equal(page, like.page) else Facts(page)


# ---- channels and geometry
def saturation(page: np.ndarray) -> np.ndarray:
    """Spread of the channels."""
    low, high = K.extremes(page)
    return high.astype(np.int16) - low


def box_mask(shape: tuple[int, int], box: tuple[float, float, float, float]) -> np.ndarray:
    h, w = shape
    x0, x1 = sorted(int(round(min(max(v, 0.0), 1.0) * w)) for v in (box[0], box[2]))
    y0, y1 = sorted(int(round(min(max(v, 0.0), 1.0) * h)) for v in (box[1], box[3]))
    out = np.zeros(shape, bool)
    out[y0:y1, x0:x1] = True
    return out


@lru_cache(4)
def band_mask(shape: tuple[int, int], s: Settings) -> np.ndarray:
    """Pixels of the band; kept for pages of the same shape, so it cannot be written to."""
    h, w = shape
    x0, y0, x1, y1 = (v * n for v, n in zip(s.band, (w, h, w, h)))
    out = K.segment_band(shape, x0, y0, x1, y1, s.band_width * min(h, w))
    out.setflags(write=False)
    return out


def line_band(shape: tuple[int, int], x0: float, y0: float, x1: float, y1: float, width: float) -> np.ndarray:
    """Pixels at most ``width`` from the infinite line."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    dx, dy = x1 - x0, y1 - y0
    return abs((x - x0) * dy - (y - y0) * dx) <= width * max(np.hypot(dx, dy), 1e-9)


def local_background(gray: np.ndarray, size: int = 15) -> np.ndarray:
    """Median background; the kernel is odd and between 15 and 151."""
    return K.median_blur(gray, min(151, max(15, size)) | 1)


def edges(gray: np.ndarray, strength: int = 40) -> np.ndarray:
    """Pixels whose value changes strongly to the right or downwards."""
    g = gray.astype(np.int16)
    out = np.zeros(g.shape, bool)
    out[:, 1:] |= abs(np.diff(g, axis=1)) >= strength
    out[1:] |= abs(np.diff(g, axis=0)) >= strength
    return out


def straight_strokes(mask: np.ndarray, span: int) -> np.ndarray:
    """Long horizontal or vertical strokes."""
    return K.opened(mask, 1, span) | K.opened(mask, span, 1)


def drop_specks(mask: np.ndarray, area: int) -> np.ndarray:
    return K.keep_components(mask, least_area=area)


def keep_long(mask: np.ndarray, area: int, span: int) -> np.ndarray:
    return K.keep_components(mask, least_area=area, least_span=span)


# ---- guards
@fact
def text_guard(page: np.ndarray, s: Settings) -> np.ndarray:
    """Dark or locally contrasted strokes, without specks."""
    g = page.gray
    strokes, middle = g <= s.dark, (g > s.dark) & (g < s.gray_low)
    if middle.any():
        strokes = strokes | (middle & (K.gaussian_blur(g, 9) - g >= s.local_contrast))
    return drop_specks(strokes, s.speck)


@fact
def colored_ink(page: np.ndarray, s: Settings) -> np.ndarray:
    """Coloured pixels that are no pale fill."""
    sat, g = page.saturation, page.gray
    return (sat > s.saturation) & (g < 235) & ~((page.brightest >= 200) & (sat <= 110) & (g >= 170))


@fact
def protect_mask(page: np.ndarray, s: Settings) -> np.ndarray:
    """Content that no step may touch: dark and anti-aliased strokes, coloured ink, strong edges on them, long lines."""
    guard = text_guard(page, s) | colored_ink(page, s)
    return guard | (edges(page.gray) & K.dilate(guard) if guard.any() else guard) | long_strokes(page, s)


@fact
def long_strokes(page: np.ndarray, s: Settings) -> np.ndarray:
    """Straight strokes that are no paper."""
    return straight_strokes(page.gray <= s.gray_low, s.stroke_span)


@fact
def header_right_guard(page: np.ndarray, s: Settings) -> np.ndarray:
    """Strokes of real header text in the top right box, dilated."""
    return K.dilate(box_mask(page.shape, s.header_right) & (page.gray <= s.gray_low))


def blocker(page: np.ndarray | Facts, cleaned: np.ndarray | Facts, s: Settings) -> np.ndarray:
    """Content of the page before or after cleaning, without specks, dilated."""
    content = protect_mask(page, s) | protect_mask(cleaned, s) | panels(page, s)[0]
    return K.dilate(drop_specks(content, s.speck))


# ---- header, footer, diagonal
def clean_header_footer(page: np.ndarray | Facts, s: Settings, guard: np.ndarray | None = None) -> np.ndarray:
    """Whiten gray pixels of little saturation in two central boxes."""
    page = facts(page)
    g = page.gray
    inside = box_mask(page.shape, s.header_box) | box_mask(page.shape, s.footer_box)
    act = inside & (g >= s.gray_low) & (g <= s.gray_high) & (page.saturation <= s.saturation)
    out = page.page.copy()
    out[act & ~(text_guard(page, s) if guard is None else guard)] = 255
    return out


@fact
def pale_background(page: np.ndarray, s: Settings) -> np.ndarray:
    """Pale coloured fill, closed."""
    sat, g = page.saturation, page.gray
    fill = (sat >= s.panel_saturation) & (sat <= 110) & (g >= 170) & (page.brightest >= 200)
    return K.close(fill & ~text_guard(page, s), 5, 5) if fill.any() else fill


def component_targets(page: np.ndarray | Facts, area: np.ndarray, s: Settings) -> np.ndarray:
    """Target colour of every pixel: white, and in each component of ``area`` the median colour of its clean pixels."""
    page = facts(page)
    out = np.full(page.page.shape, 255, np.uint8)
    labels, stats = K.components(area)
    clean = ~protect_mask(page, s)
    for k in range(1, len(stats) + 1):
        box = K.in_box(stats, k)
        own = labels[box] == k
        use = own & clean[box]
        out[box][own] = K.median_color(page.page[box][use if use.sum() >= 5 else own]).astype(np.uint8)
    return out


def clean_diagonal(page: np.ndarray | Facts, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Remove the diagonal overlay: candidates in the band, their halo and the corridor outside panels, minus content."""
    page = facts(page)
    g, band = page.gray, band_mask(page.shape, s)
    panel = pale_background(page, s)
    target = component_targets(page, panel, s)
    candidate = band & (g >= s.gray_low) & (g <= s.gray_high) & (page.saturation <= s.saturation)
    halo = candidate
    for _ in range(s.halo):
        halo = K.dilate(halo)
    corridor = band & ~panel & (g > s.gray_low)
    mask = (candidate | (halo & band) | corridor) & ~protect_mask(page, s)
    out = page.page.copy()
    out[mask] = target[mask]
    return out, mask


# ---- colour panels
@fact
def panels(page: np.ndarray, s: Settings) -> tuple[np.ndarray, list[tuple[int, int, int, int, tuple[int, int, int]]]]:
    """Mask and geometry (x, y, width, height, colour) of coloured panels: large, well filled components."""
    labels, stats = K.components(pale_background(page, s))
    h, w = page.shape
    out, found = np.zeros((h, w), bool), []
    for k, (x, y, bw, bh, area) in enumerate(stats.tolist(), 1):
        if area >= s.panel_area * h * w and area >= s.panel_fill * bw * bh and 0.05 <= bw / bh <= 40:
            box = K.in_box(stats, k)
            own = labels[box] == k
            out[box] |= own
            found.append((x, y, bw, bh, tuple(int(v) for v in K.median_color(page.page[box][own]))))
    return out, found


def preserve_panels(page: np.ndarray | Facts, cleaned: np.ndarray, s: Settings, holes: float = 0.25) -> np.ndarray:
    """Give panels back what cleaning took: patch holes with the panel's colour, or restore a panel that lost too much."""
    page = facts(page)
    out = cleaned.copy()
    for x, y, w, h, color in panels(page, s)[1]:
        box = (slice(y, y + h), slice(x, x + w))
        lost = K.differs(page.page[box], cleaned[box], 3) & ~protect_mask(page, s)[box]
        if lost.mean() > holes:
            out[box] = page.page[box]
        else:
            out[box][lost] = color
    return out


def recolor_flat_panels(page: np.ndarray | Facts, s: Settings, most_std: float = 14.0, most_delta: float = 30.0) -> np.ndarray:
    """Residue on flat panels: a panel whose pale pixels vary little is painted in its colour."""
    page = facts(page)
    out = page.page.copy()
    for x, y, w, h, color in panels(page, s)[1]:
        box = (slice(y, y + h), slice(x, x + w))
        free = ~protect_mask(page, s)[box]
        if not free.any():
            continue
        delta = K.extremes(abs(page.page[box].astype(int) - np.array(color)))[1][free]
        if delta.std() <= most_std and np.percentile(delta, 95) <= most_delta:
            out[box][free] = color
    return out


def panel_gate(page: np.ndarray | Facts, s: Settings) -> bool:
    """Whether enough panel pixels lie in the band."""
    page = facts(page)
    return int((panels(page, s)[0] & band_mask(page.shape, s)).sum()) >= s.panel_gate


# ---- tables
@fact
def table_cells(page: np.ndarray, s: Settings) -> list[tuple[int, int, int, int, tuple[int, int, int]]]:
    """Coloured cells: filled components between table strokes."""
    labels, stats = K.components(pale_background(page, s) & ~long_strokes(page, s))
    cells = []
    for k, (x, y, w, h, area) in enumerate(stats.tolist(), 1):
        if w >= 8 and h >= 6 and area >= 0.5 * w * h and area <= 0.5 * page.shape[0] * page.shape[1]:
            box = K.in_box(stats, k)
            cells.append((x, y, w, h, tuple(int(v) for v in K.median_color(page.page[box][labels[box] == k]))))
    return cells


@fact
def table_protection(page: np.ndarray, s: Settings) -> np.ndarray:
    """Cells and the long strokes next to them, dilated: cleaning stays out."""
    out = np.zeros(page.shape, bool)
    for x, y, w, h, _ in table_cells(page, s):
        out[y : y + h, x : x + w] = True
    if not out.any():
        return out
    return K.dilate(out | (long_strokes(page, s) & K.dilate(out, 9, 9)))


def restore_strokes(page: np.ndarray | Facts, cleaned: np.ndarray, area: np.ndarray, s: Settings) -> np.ndarray:
    """Copy original strokes (dark or coloured) in ``area`` back."""
    page = facts(page)
    out = cleaned.copy()
    if area.any():
        back = area & ((page.gray <= s.gray_low) | colored_ink(page, s))
        out[back] = page.page[back]
    return out


def clean_tables(page: np.ndarray | Facts, cleaned: np.ndarray, s: Settings) -> np.ndarray:
    """Repaint each cell's pale pixels in the cell's median colour; borders come back from the original."""
    page = facts(page)
    out = cleaned.copy()
    area = np.zeros(page.shape, bool)
    for x, y, w, h, color in table_cells(page, s):
        box = (slice(y, y + h), slice(x, x + w))
        out[box][~protect_mask(page, s)[box]] = color
        area[box] = True
    return restore_strokes(page, out, K.dilate(area, 7, 7), s)


def restore_graph(page: np.ndarray | Facts, cleaned: np.ndarray, s: Settings) -> np.ndarray:
    """Bring back graph strokes in the band: black lines, blue curves and the markers on them."""
    page = facts(page)
    blue = (page.page[..., 2].astype(np.int16) - page.page[..., 0] > 40) & (page.gray < 200)
    black = keep_long(page.gray <= s.dark, s.speck, s.stroke_span // 2)
    back = keep_long(blue, 5, 5) | black
    out = cleaned.copy()
    out[back] = page.page[back]
    return out


# ---- ruled lines
@fact
def rule_scores(page: np.ndarray, half: int = 7) -> np.ndarray:
    """How much darker each row is than the moving median of the rows around it."""
    rows = np.median(page.gray, axis=1).astype(float)
    padded = np.pad(rows, half, mode="edge")
    return np.maximum(np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1) - rows, 0)


def detect_centers(page: np.ndarray, s: Settings) -> tuple[list[int], int]:
    """Rows of the ruled grid and its spacing: best (spacing, phase), refined to local maxima, missing rows filled in."""
    score = rule_scores(page)
    spacing, phase, value = K.ruled_grid(-score, least=6, most=80)
    if not spacing or value < s.rule_contrast / 2:
        return [], 0
    centers = []
    for y in range(phase, len(score), spacing):
        a = max(0, y - 2)
        near = score[a : y + 3]
        centers.append(a + int(near.argmax()) if near.max() >= s.rule_contrast / 2 else y)
    return centers, spacing


@fact
def footer_border(page: np.ndarray, s: Settings) -> int | None:
    """Lowest group of rows that a dark line covers, in the lower quarter."""
    h = page.shape[0]
    cover = (page.gray <= s.gray_low).mean(1)
    rows = np.flatnonzero(cover[3 * h // 4 :] >= 0.5) + 3 * h // 4
    if not len(rows):
        long = straight_strokes(page.gray <= s.gray_low, max(s.stroke_span, page.shape[1] // 3)).any(1)
        rows = np.flatnonzero(long[3 * h // 4 :]) + 3 * h // 4
    if not len(rows):
        return None
    groups = np.split(rows, np.flatnonzero(np.diff(rows) > 2) + 1)
    return int(np.median(groups[-1]))


def extend_centers(centers: list[int], border: int | None) -> list[int]:
    """Continue a grid with its median spacing down to the border."""
    if len(centers) < 2 or border is None:
        return centers
    step = int(np.median(np.diff(centers)))
    out = list(centers)
    while step > 0 and out[-1] + step < border - step // 2:
        out.append(out[-1] + step)
    return out


@fact
def rule_evidence(page: np.ndarray, s: Settings) -> np.ndarray:
    """Paper-like pixels slightly darker than their vertical neighbourhood, closed along the row."""
    g = page.gray
    thin = (K.column_median(g).astype(np.int16) - g >= s.rule_contrast) & (g > s.dark) & (page.saturation <= 60)
    return K.close(thin, 1, s.gap)


def filter_centers(centers: list[int], evidence: np.ndarray, s: Settings, least: int = 3) -> list[int]:
    """Centers whose rows show enough evidence; none if too few do."""
    good = [y for y in centers if evidence[max(0, y - 1) : y + 2].any(0).mean() >= s.rule_cover]
    return good if len(good) >= least else []


def grid_confidence(centers: list[int], evidence: np.ndarray) -> float:
    """Evidence on the rows, regularity of their spacing, and their number, weighted."""
    if len(centers) < 2:
        return 0.0
    shown = float(np.mean([evidence[max(0, y - 1) : y + 2].any(0).mean() for y in centers]))
    gaps = np.diff(centers)
    step = max(float(np.median(gaps)), 1.0)
    regular = max(0.0, 1 - float(np.median(abs(gaps - step))) / step)
    return 0.52 * min(1.0, shown) + 0.33 * regular + 0.15 * min(1.0, len(centers) / 12)


def damage_gate(diagonal: np.ndarray, band: np.ndarray, grow: int = 2) -> np.ndarray:
    """Where the diagonal's removal may have hurt lines."""
    for _ in range(grow):
        diagonal = K.dilate(diagonal)
    return diagonal & band


def bridge_gate(evidence: np.ndarray, centers: list[int], s: Settings) -> np.ndarray:
    """Gaps between pieces of a line that closing along its row bridges."""
    out = np.zeros(evidence.shape, bool)
    closed = K.close(evidence, 1, 4 * s.gap + 1)
    for y in centers:
        rows = slice(max(0, y - 1), y + 2)
        out[rows] = closed[rows] & ~evidence[rows]
    return out


def reconstruction_gate(confidence: float, gate: np.ndarray, band: np.ndarray, s: Settings) -> np.ndarray:
    """Nothing below the confidence limit; the band only, unless the whole page is allowed."""
    if confidence < s.rule_confidence:
        return np.zeros(gate.shape, bool)
    return gate if s.full_page else gate & band


def rebuild_background(page: np.ndarray | Facts, cleaned: np.ndarray | Facts, band: np.ndarray, block: np.ndarray, s: Settings) -> np.ndarray:
    """Blend paper-like pixels of the band that are no content towards the page's paper colour."""
    cleaned = facts(cleaned)
    g = cleaned.gray
    act = band & ~block & (g > s.gray_low) & (cleaned.saturation <= s.saturation)
    clean = ~block & ~band & (g > s.gray_high - 20)
    paper = K.median_color(cleaned.page[clean]) if clean.any() else np.array([255, 255, 255])
    out = cleaned.page.copy()
    out[act] = np.rint((1 - s.blend) * out[act] + s.blend * paper).astype(np.uint8)
    return out


def restore_rules(page: np.ndarray | Facts, cleaned: np.ndarray, centers: list[int], gate: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Draw lines through the gate in the colour that their visible parts have, softer on the edge rows."""
    if not centers or not gate.any():
        return cleaned.copy()
    out = cleaned.astype(float)
    page = facts(page).page
    colors = np.percentile(page[centers], 25, axis=1)
    for y, color in zip(centers, colors):
        for dy, alpha in ((0, 0.9), (-1, 0.35), (1, 0.35)):
            if 0 <= y + dy < len(page):
                act = gate[y + dy] & ~block[y + dy]
                out[y + dy][act] = np.minimum(out[y + dy][act], (1 - alpha) * out[y + dy][act] + alpha * color)
    return np.rint(out).astype(np.uint8)


def is_ruled(page: np.ndarray | Facts, span: float = 0.35) -> bool:
    """Fast test: strong rows that spread over enough of the page."""
    score = rule_scores(page)
    strong = np.flatnonzero(score >= max(2.0, np.percentile(score, 85)))
    return len(strong) >= 3 and (strong[-1] - strong[0]) >= span * len(score)


# ---- the pass
def clean(page: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, dict]:
    """Header and footer, diagonal, panels, background, tables, graph strokes, panel residue, ruled lines; in this order.

    Returns the page, and masks and figures of the pass.
    """
    page = facts(page)
    band = band_mask(page.shape, s)
    guard = text_guard(page, s) | header_right_guard(page, s)
    framed = facts(clean_header_footer(page, s, guard), page)
    hard = table_protection(page, s)
    swept, diagonal = clean_diagonal(framed, s)
    out = np.where((diagonal & ~hard)[..., None], swept, framed.page)
    kept = facts(preserve_panels(page, out, s), framed)
    block = blocker(page, kept, s) | hard
    out = rebuild_background(page, kept, band, block, s)
    out = clean_tables(page, out, s)
    out = restore_graph(page, out, s)
    if panel_gate(page, s):
        out = recolor_flat_panels(out, s)
    meta = {"ruled": is_ruled(page), "centers": 0, "confidence": 0.0, "diagonal": int(diagonal.sum())}
    if meta["ruled"]:
        evidence = rule_evidence(page, s)
        centers = filter_centers(extend_centers(detect_centers(page, s)[0], footer_border(page, s)), evidence, s)
        meta |= {"centers": len(centers), "confidence": round(grid_confidence(centers, evidence), 6)}
        gate = reconstruction_gate(meta["confidence"], damage_gate(diagonal, band) | bridge_gate(evidence, centers, s), band, s)
        out = restore_rules(page, out, centers, gate, K.dilate(protect_mask(page, s)))
    return out, meta


K.register("ruled", lambda page: clean(page if page.ndim == 3 else np.repeat(page[..., None], 3, 2))[0] if page.ndim == 3 else K.gray(clean(np.repeat(page[..., None], 3, 2))[0]))
