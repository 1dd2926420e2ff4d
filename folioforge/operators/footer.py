"""Footer polish: pale residue of an overlay in the footer becomes paper; page number, rules, colour and everything above stay.

Each step is a function: what must stay (``outer_guard``), what the footer is made of (``Footer``), which pixels are residue
(``Footer.residue``), how much of it there is (``score``), its removal (``cleaned``), and the harm done (``protected_change``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K


@dataclass(frozen=True)
class Settings:
    """Boxes as shares of the page, and the limits of the steps."""

    box: tuple[float, float, float, float] = (0.32, 0.955, 0.75, 0.997)
    number_box: tuple[float, float, float, float] = (0.80, 0.955, 1.00, 1.00)
    upper: float = 0.945
    limit: float = 0.035
    level: str = "auto"


#: By level, the contrast from which a pixel is residue and by how many pixels residue is grown.
LEVELS = {"standard": (4.0, 1), "deep": (2.0, 2)}
#: Contrast that counts in the score; gray steps below paper of rules and of anything that is not paper; spread of colour.
SCORED, RULE_STEP, PAPER_STEP, COLORED, PALE = 3.0, 25, 12, 30, 35
#: Shortest rule in pixels and as a share of the footer; sides of the blur that estimates the paper.
RULE_LEAST, RULE_SHARE, BLUR = 35, 0.10, (25, 51)
#: Components that are noise or texture.
LEAST_AREA, MOST_AREA, MOST_SPAN = 2, 0.50, (0.75, 0.85)


def pixels(box: tuple[float, float, float, float], height: int, width: int) -> tuple[slice, slice]:
    """A box of shares as slices of rows and columns; empty if nothing is left of it."""
    x0, y0, x1, y1 = (max(0, min(size, int(round(v * size)))) for v, size in zip(box, (width, height, width, height)))
    return (slice(y0, y1), slice(x0, x1)) if x1 > x0 and y1 > y0 else (slice(0, 0), slice(0, 0))


def outer_guard(shape: tuple[int, int], s: Settings, content: np.ndarray | None = None) -> np.ndarray:
    """Pixels that stay whatever they look like: the page above the footer, the page number, and known content."""
    guard = np.zeros(shape, bool)
    guard[: max(0, min(shape[0], int(round(s.upper * shape[0]))))] = True
    guard[pixels(s.number_box, *shape)] = True
    if content is not None:
        if content.shape != shape:
            raise ValueError("content mask and page differ in shape")
        guard |= content > 0
    return guard


def saturation(page: np.ndarray) -> np.ndarray:
    """Saturation of the HSV form, 0 to 255."""
    low, high = (v.astype(float) for v in K.extremes(page))
    return np.rint(np.divide(255 * (high - low), high, out=np.zeros_like(high), where=high > 0))


def _odd(size: int, most: int) -> int:
    size = min(size, most)
    return max(1, size - (1 - size % 2))


class Footer:
    """The footer's pixels, its guard, and the paper under it."""

    def __init__(self, part: np.ndarray, outer: np.ndarray):
        self.gray, self.saturation = K.gray(part).astype(float), saturation(part)
        self.guard, self.paper = outer.copy(), part.astype(float)
        free = ~outer
        level = float(np.percentile(self.gray[free], 95)) if free.any() else 255.0
        if free.any():
            if part.shape[1] >= RULE_LEAST:
                dark = (self.gray < level - RULE_STEP) & (self.saturation <= PALE) & free
                self.guard |= K.dilate(K.opened(dark, 1, max(RULE_LEAST, int(round(part.shape[1] * RULE_SHARE)))))
            self.guard |= K.dilate((self.saturation > COLORED) & free)
        free = ~self.guard
        if free.any():
            tint = np.percentile(part[free], 95, axis=0)
            self.paper[self.guard | (self.gray < level - PAPER_STEP)] = tint
            if min(part.shape[:2]) >= 3:
                sides = [_odd(n, most) for n, most in zip(part.shape[:2], BLUR)]
                self.paper = K.gaussian_blur(np.ascontiguousarray(self.paper.transpose(2, 0, 1)), *sides).transpose(1, 2, 0)
        self.paper = np.clip(np.floor(self.paper + 1e-6), 0, 255).astype(np.uint8)
        self.contrast = np.maximum(K.gray(self.paper).astype(float) - self.gray, 0)

    def residue(self, least: float) -> np.ndarray:
        """Pale pixels darker than the paper, without specks and broad texture."""
        labels, stats = K.components(~self.guard & (self.saturation <= PALE) & (self.contrast >= least))
        h, w = self.gray.shape
        broad = (stats[:, 4] > int(round(MOST_AREA * w * h))) | ((stats[:, 2] > int(MOST_SPAN[1] * w)) & (stats[:, 3] > int(MOST_SPAN[0] * h)))
        return np.concatenate([[False], (stats[:, 4] >= LEAST_AREA) & ~broad])[labels]


class Measured:
    """A page's footer and guard, worked out once for its score and for both levels."""

    def __init__(self, page: np.ndarray, s: Settings, content: np.ndarray | None):
        self.page, self.at = page, pixels(s.box, *page.shape[:2])
        self.outer = outer_guard(page.shape[:2], s, content)
        self.size = self.outer[self.at].size
        self.footer = Footer(page[self.at], self.outer[self.at]) if self.size else None

    def score(self) -> float:
        return float(min(1.0, self.footer.contrast[self.footer.residue(SCORED)].sum() / (255.0 * self.size))) if self.size else 0.0

    def cleaned(self, level: str) -> tuple[np.ndarray, np.ndarray]:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        least, grow = LEVELS[level]
        out, guard = self.page.copy(), self.outer.copy()
        if self.size:
            found = self.footer.residue(least)
            for _ in range(grow):
                found = K.dilate(found)
            found &= ~self.footer.guard
            out[self.at][found] = self.footer.paper[found]
            guard[self.at] = self.footer.guard
        return out, guard


def score(page: np.ndarray, s: Settings = Settings(), content: np.ndarray | None = None) -> float:
    """Contrast of the residue, as a share of the footer's pixels at full contrast."""
    return Measured(page, s, content).score()


def cleaned(page: np.ndarray, level: str, s: Settings = Settings(), content: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The page with its residue turned into paper, and the guard of the whole page."""
    return Measured(page, s, content).cleaned(level)


def protected_change(before: np.ndarray, after: np.ndarray, guard: np.ndarray, s: Settings = Settings()) -> float:
    """Changed pixels that should have stayed, guarded ones and all outside of the footer, by the guarded ones in the footer."""
    inside = np.zeros(guard.shape, bool)
    inside[pixels(s.box, *guard.shape)] = True
    changed = K.differs(before, after)
    return float((changed & (guard | ~inside)).sum() / max(1, (guard & inside).sum()))


def polish(page: np.ndarray, s: Settings = Settings(), content: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Page and metrics.  ``auto``: the standard pass, and the deep one on the original page if too much is left."""
    gray = page.ndim == 2
    page = np.repeat(page[..., None], 3, 2) if gray else page
    measured = Measured(page, s, content)
    was = measured.score()
    for level in ("standard", "deep") if s.level == "auto" else (s.level,):
        out, guard = measured.cleaned(level)
        left = score(out, s, content) if K.differs(out, page).any() else was
        if left <= s.limit:
            break
    metrics = {
        "level": level, "changed": int(K.differs(out, page).sum()), "score_before": was, "score": left,
        "protected_change": protected_change(page, out, guard, s),
    }
    return out[..., 0] if gray else out, metrics
