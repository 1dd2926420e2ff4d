import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import guided as G
from folioforge.operators import kernels as K
from folioforge.operators import ruledpages as R


def scan():
    page = np.full((400, 300, 3), 252, np.uint8)
    page[R.band_mask((400, 300), R.Settings())] = 222
    page[3:9, 110:190] = 215
    page[100:104, 40:200] = 15
    return page


def test_probe():
    clean = np.full((400, 300, 3), 255, np.uint8)
    assert G.probe([scan(), scan()]) > 0.9 and 0 < G.probe([scan(), clean]) <= 0.84 and G.probe([clean, clean]) == 0 and G.probe([]) == 0
    assert G.diagonal_prior((100, 100))[75, 25] == False and G.work_size((400, 300), (842.0, 595.0), 72) == (400, 300)  # noqa: E712


def test_clean_native():
    page = scan()
    out, m = G.clean_native(page, (842.0, 595.0))
    dark = K.gray(page) <= 105
    assert (out[dark] == page[dark]).all() and m["residual"] < 0.5 and m["changed"] > 0
    assert G.page_metrics(page, out)["ok"] and not G.page_metrics(page, np.full_like(page, 255))["ok"] and not G.page_metrics(page, page[:9])["ok"]
    paper = K.paper(K.gray(page).astype(float))
    assert G.residual(page, page, np.ones((400, 300), bool), paper) == 1.0 and G.residual(page, page, np.zeros((400, 300), bool), paper) == 0.0


def test_normalise():
    assert G.normalise((np.full((2, 2), 300),)).shape == (2, 2, 3) and G.normalise(np.zeros((2, 2, 4))).shape == (2, 2, 3)
    with pytest.raises(ValueError):
        G.normalise(np.zeros(3))
    assert [p.shape for p in G.sample_native([scan()] * 20, 3, 200)] == [(200, 150)] * 3


def test_frames(spark):
    cand = spark.createDataFrame([("a", "m", 2, True, 0.9)], "document string, marker string, n_pages long, repeated boolean, confidence double")
    prof = spark.createDataFrame([("a", "raster", 0.9), ("b", "raster", 0.9), ("c", "vector", 0.1)], "document string, kind string, full_page_image_ratio double")
    probes = spark.createDataFrame([("a", 0.9, 2), ("b", 0.8, 2), ("c", 0.9, 2)], "document string, confidence double, n_pages long")
    assert sorted(r.document for r in G.add_probe(cand, prof, probes, "m").collect()) == ["a", "b"]
    places = spark.createDataFrame([("a", 1, 50.0, 100.0), ("a", 1, 300.0, 100.0), ("a", 2, 5.0, 0.0)], "document string, page_id long, area double, page_area double")
    assert {r.page_id: r.coverage for r in G.coverage(places).collect()} == {1: 1.0, 2: 0.0}
    pages = spark.createDataFrame(
        [("a", 1, 0, 0, ["http://ok.org/x"], 0, 1.0), ("a", 2, 90, 0, [], 0, 1.0), ("a", 3, 0, 0, ["http://no.org"], 0, 1.0), ("a", 4, 0, 0, [], 7, 1.0), ("a", 5, 0, 0, [], 0, 0.5)],
        "document string, page_id long, rotation int, n_annotations int, links array<string>, n_chars int, coverage double",
    )
    assert {r.page_id: r.reason for r in G.unsafe_pages(pages, ("ok.org",)).collect()} == {2: "rotation", 3: "links", 4: "text", 5: "image"}
    assert {r["rule"]: r.n_rows for r in G.violations(pages, {"unit": "coverage between 0 and 1", "full": "coverage >= 0.9"}).collect()} == {"full": 1}
    assert [r.fingerprint for r in G.missing_from(spark.createDataFrame([("x",), ("y",)], "fingerprint string"), spark.createDataFrame([("x", 1)], "fingerprint string, p int")).collect()] == ["y"]
    assert cand.select(F.lit(1)).count() == 1


def test_footer_is_measured_once(monkeypatch):
    """One footer serves the score and both levels; only a changed page is measured again."""
    from folioforge.operators import footer

    built = []
    monkeypatch.setattr(footer.Footer, "__init__", lambda self, *args, f=footer.Footer.__init__: built.append(1) or f(self, *args))
    page = np.full((400, 300, 3), 250, np.uint8)
    assert footer.polish(page)[1]["changed"] == 0 and len(built) == 1
    page[388:391, 104:107] = 205
    out, metrics = footer.polish(page)
    assert metrics["changed"] == 9 and (out == 250).all() and len(built) == 3
    page[385:395, 100:220:3] = 200
    built.clear()
    footer.polish(page, footer.Settings(limit=-1.0))
    assert len(built) == 3


def test_channels_at_once():
    """Resizing and blurring a page at once is what its channels give one by one."""
    from folioforge.operators import kernels

    page = np.random.default_rng(2).integers(0, 256, (37, 52, 3)).astype(np.uint8)
    for how in ("nearest", "area", "cubic"):
        one = np.stack([kernels.resize(page[..., c], 23, 61, how) for c in range(3)], -1)
        assert (kernels.resize(page, 23, 61, how) == one).all()
    blurred = kernels.gaussian_blur(np.ascontiguousarray(page.transpose(2, 0, 1)), 9, 15)
    assert all((blurred[c] == kernels.gaussian_blur(page[..., c], 9, 15)).all() for c in range(3))
