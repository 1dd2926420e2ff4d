"""Pixel kernels: invariants on small images, against slow versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.operators import footer
from folioforge.operators import kernels as K

masks = st.integers(0, 2**32 - 1).map(lambda s: np.random.default_rng(s).random((9, 11)) < 0.4)


def _flood(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, size = [(y, x)], 0
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                size += 1
                for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            out.append(size)
    return sorted(out)


@given(masks)
@settings(max_examples=60, deadline=None)
def test_components(mask):
    labels, stats = K.components(mask)
    assert sorted(stats[:, 4].tolist()) == _flood(mask) and ((labels > 0) == mask).all()
    for i, (x, y, w, h, n) in enumerate(stats, 1):
        ys, xs = np.nonzero(labels == i)
        assert (xs.min(), ys.min(), xs.max() - x + 1, ys.max() - y + 1, len(xs)) == (x, y, w, h, n)


@given(masks)
@settings(max_examples=40, deadline=None)
def test_morphology(mask):
    grown = K.dilate(mask)
    slow = np.array([[mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(11)] for y in range(9)])
    assert (grown == slow).all() and (K.erode(mask) == ~K.dilate(~mask)).all()
    assert (K.opened(mask) <= mask).all() and (mask <= K.close(mask)).all()


def test_merge_rects():
    assert K.merge_rects([(0, 0, 1, 1), (3, 0, 4, 1), (10, 10, 11, 11)], gap=2) == [(0, 0, 4, 1), (10, 10, 11, 11)]
    assert K.merge_rects([(0, 0, 1, 1), (8, 0, 9, 1), (0, 0, 9, 0)]) == [(0, 0, 9, 1)]
    # Page 8054 of the check tool's table: each union reaches the next box only then, seven times over.
    boxes = [(3, 0, 3, 0), (0, 1, 0, 2), (6, 1, 7, 2), (3, 2, 3, 2), (5, 3, 5, 3), (2, 4, 2, 4), (7, 4, 7, 4), (4, 5, 4, 5), (1, 6, 1, 7), (6, 6, 7, 7)]
    assert K.merge_rects(boxes, gap=1) == [(0, 0, 7, 7)]


def _pages(n=5):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:180, :240]
    overlay = abs((x - 120) * 0.6 - (y - 90)) < 3
    pages = []
    for i in range(n):
        p = 240 + rng.integers(-2, 3, (180, 240))
        p[overlay] = 205 + rng.integers(-2, 3, overlay.sum())
        p[20 + 25 * i : 25 + 25 * i, 30:200] = 20
        pages.append(np.clip(p, 0, 255).astype(np.uint8))
    return pages, overlay


def test_model_and_repair():
    pages, overlay = _pages()
    mask, _, confidence = K.learn(pages)
    assert confidence > 0.8 and (mask & overlay).sum() > 0.8 * overlay.sum() and (mask & ~overlay).sum() < 0.1 * mask.size
    out, changed = K.repair(pages[0], mask)
    assert changed > 0 and (out[pages[0] <= 105] == pages[0][pages[0] <= 105]).all() and (out >= pages[0]).all() and (out[~mask] == pages[0][~mask]).all()
    with pytest.raises(ValueError):
        K.learn(pages[:1])


def test_footer():
    page = np.full((1000, 800, 3), 255, np.uint8)
    page[970:976, 300:330] = 225
    page[965:980, 700:720] = 0
    page[985, 50:750] = 60
    page[960:965, 500:520] = (255, 0, 0)
    out, m = footer.polish(page)
    assert (out[970:976, 300:330] == 255).all() and m["level"] == "standard" and m["score"] <= 0.035 < 1 and m["score_before"] > m["score"]
    keep = np.ones((1000, 800), bool)
    keep[965:980, 295:335] = False
    assert (out[keep] == page[keep]).all() and m["changed"] == 180 and m["protected_change"] == 0
    clean = np.full((100, 80, 3), 250, np.uint8)
    assert (footer.polish(clean)[0] == clean).all() and footer.polish(clean[..., 0])[0].shape == (100, 80)
    hard = footer.Settings(limit=-1.0)
    assert footer.polish(page, hard)[1]["level"] == "deep"
    content = np.zeros((1000, 800), bool)
    content[970:976, 300:330] = True
    assert (footer.polish(page, content=content)[0] == page).all()
    with pytest.raises(ValueError):
        footer.cleaned(page, "none")
    with pytest.raises(ValueError):
        footer.polish(page, content=content[1:])
    harmed = page.copy()
    harmed[0, 0] = 7
    assert footer.protected_change(page, harmed, footer.cleaned(page, "standard")[1]) > 0


def test_resize_and_blur():
    a = np.arange(24, dtype=float).reshape(4, 6)
    assert (K.resize(a, 2, 3, "area") == a.reshape(2, 2, 3, 2).mean((1, 3))).all()
    assert (K.resize(a, 8, 12) == np.repeat(np.repeat(a, 2, 0), 2, 1)).all()
    assert np.allclose(K.resize(np.full((3, 3), 7.0), 5, 4, "cubic"), 7) and np.allclose(K.resize(a, 4, 6, "cubic"), a)
    far = lambda d: -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3
    near = lambda d: 1.25 * d**3 - 2.25 * d**2 + 1
    row = np.array([[3.0, 50, 7, 90, 20]])
    at = 2 * 2 + 1  # the pixel at 2.25: a quarter behind the middle one
    assert np.isclose(K.resize(row, 1, 10, "cubic")[0, at], far(1.25) * 50 + near(0.25) * 7 + near(0.75) * 90 + far(1.75) * 20)
    assert np.allclose(K.resize(np.full((3, 3), 7.0), 5, 4, "linear"), 7) and np.allclose(K.gaussian_blur(np.full((9, 9), 7.0), 5), 7)


def test_grid():
    means = np.full(60, 250.0)
    means[4::12] = 200
    assert K.ruled_grid(means, 5, 20)[:2] == (12, 4)


def test_grid_in_one_go():
    """All grids are summed at once, with the choice of a loop over them."""
    from unittest import mock

    rng = np.random.default_rng(5)
    for n in (1, 9, 14, 40, 97):
        means = rng.integers(0, 60, n) / 2.0
        base = np.array([np.median(means[max(0, i - 7) : i + 8]) for i in range(n)])
        score, best = np.maximum(base - means, 0), (0, 0, 0.0)
        for spacing in range(3, min(60, n // 2) + 1):
            for phase in range(spacing):
                on = score[phase::spacing]
                value = float(on.mean() - score.mean()) * min(1.0, len(on) / 4) * float(on.sum() / max(score.sum(), 1e-9))
                if value > best[2] + 1e-12:
                    best = (spacing, phase, value)
        with mock.patch.object(K.np, "bincount", wraps=np.bincount) as summed:
            assert K.ruled_grid(means) == best and summed.call_count == (n // 2 >= 3)


def test_process(spark):
    pages, _ = _pages(2)
    rows = spark.createDataFrame(K.to_rows([("d", i, p) for i, p in enumerate(pages)]), K.PAGE)
    assert all(r.error is None for r in K.process(rows, "median").collect())
    K.register("broken", lambda p: 1 / 0)
    got = K.process(rows, "broken").orderBy("page_id").collect()
    assert all("ZeroDivisionError" in r.error for r in got) and bytes(got[0].data) == pages[0].tobytes()
    with pytest.raises(ValueError):
        K.process(rows, "none")
    models = K.learn_models(rows)
    assert all(r.changed_pixels > 0 for r in K.apply_models(rows, models).collect())
