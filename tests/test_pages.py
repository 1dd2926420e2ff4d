"""Page passes: invariants on drawn pages; configuration; the document job."""

import json
import struct
import zlib

import numpy as np
import pytest

from folioforge.operators import inkpages as I
from folioforge.operators import kernels as K
from folioforge.operators import ruledpages as R
from folioforge.plans import config, process
from folioforge.sources import files, tables


def ruled(h=300, w=240):
    page = np.full((h, w, 3), 250, np.uint8)
    page[20:290:18] = (190, 200, 215)
    page[60:64, 30:120] = 20
    y, x = np.mgrid[:h, :w]
    overlay = K.segment_band((h, w), 0.1 * w, 0.95 * h, 0.95 * w, 0.1 * h, 6)
    page[overlay & (K.gray(page) > 120)] = 215
    return page, overlay


def test_ruled_pass():
    page, overlay = ruled()
    out, meta = R.clean(page)
    dark = K.gray(page) <= 110
    assert meta["ruled"] and meta["diagonal"] > 0 and (out[dark] == page[dark]).all()
    before, after = (abs(K.gray(p)[overlay & ~dark].astype(int) - 250).mean() for p in (page, out))
    assert after < before / 2


def test_grid():
    page = np.full((300, 200, 3), 250, np.uint8)
    page[10:290:18] = 200
    centers, spacing = R.detect_centers(page, R.Settings())
    assert spacing == 18 and set(range(10, 290, 18)) <= set(centers)
    evidence = R.rule_evidence(page, R.Settings())
    good = R.filter_centers(centers, evidence, R.Settings())
    assert R.grid_confidence(good, evidence) > 0.9 and R.filter_centers([1, 5], evidence, R.Settings()) == []
    assert R.extend_centers([10, 28, 46], 100) == [10, 28, 46, 64, 82] and R.is_ruled(page) and not R.is_ruled(np.full((300, 200, 3), 250, np.uint8))
    assert not R.reconstruction_gate(0.5, np.ones((2, 2), bool), np.ones((2, 2), bool), R.Settings()).any()


def test_panels_and_tables():
    page = np.full((200, 200, 3), 255, np.uint8)
    page[40:100, 40:160] = (200, 230, 255)
    page[60:64, 60:100] = 10
    mask, found = R.panels(page, R.Settings())
    assert len(found) == 1 and found[0][:4] == (40, 40, 120, 60) and found[0][4] == (200, 230, 255)
    hurt = page.copy()
    hurt[50:55, 50:90] = 255
    assert (R.preserve_panels(page, hurt, R.Settings()) == page).all()
    dirty = page.copy()
    dirty[80:84, 70:110] = (206, 233, 255)
    assert (R.recolor_flat_panels(dirty, R.Settings())[80:84, 70:110] == (200, 230, 255)).all()
    assert R.table_protection(page, R.Settings())[50, 50] and not R.table_protection(page, R.Settings())[150, 20]


def test_footer_border_and_header():
    page = np.full((200, 200, 3), 255, np.uint8)
    page[180] = 30
    assert R.footer_border(page, R.Settings()) == 180 and R.footer_border(np.full((200, 200, 3), 255, np.uint8), R.Settings()) is None
    page[2:5, 80:120] = 200
    out = R.clean_header_footer(page, R.Settings())
    assert (out[2:5, 80:120] == 255).all() and (out[180] == page[180]).all()
    assert R.preset("balanced").halo == 1 and R.from_mapping({"halo": 3, "nope": 1}).halo == 3
    with pytest.raises(ValueError):
        R.preset("x")


def test_ink_pass():
    page = np.full((200, 200, 3), 255, np.uint8)
    page[50:54, 20:120] = 15
    page[100:110, 20:180] = 205
    page[150:160, 50:60] = (30, 30, 200)
    out, meta = I.clean(page)
    assert (out[100:110, 20:180] == 255).all() and (out[50:54, 20:120] == 15).all() and (out[150:160, 50:60] == page[150:160, 50:60]).all()
    assert meta["removed"] > 0 and (I.clean(page, I.InkSettings(border_top=60))[0][:60] == 255).all()
    assert I.otsu(np.array([10] * 50 + [200] * 50, np.uint8)) in range(10, 200)


def test_hybrid():
    page = np.full((200, 300, 3), 200, np.uint8)
    after = page.copy()
    after[20:30, 20:60] = 255
    mask = I.change_mask(page, after)
    boxes = I.patch_boxes(mask)
    assert len(boxes) == 1 and boxes[0][0] <= 20 and boxes[0][2] >= 60 and I.choose_mode(mask, boxes) == "hybrid"
    assert (I.assemble(page, after, mask) == after).all() and I.choose_mode(np.ones((9, 9), bool), [(0, 0, 9, 9)]) == "full_raster"
    assert I.seam_risk([(0, 0, 200, 100)], (200, 300)) and I.to_points((0, 0, 300, 200), (200, 300), (150.0, 100.0), (5.0, 5.0)) == (5, 5, 155, 105)
    got = I.page_result(page, lambda p: after)
    assert got["mode"] == "hybrid" and not got["fallback"] and I.page_result(page, lambda p: 1 / 0)["fallback"]
    raw = I.png(after)
    w, h = struct.unpack(">II", raw[16:24])
    size = struct.unpack(">I", raw[33:37])[0]
    rows = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(h, -1)
    assert (w, h) == (300, 200) and (rows[:, 1:].reshape(200, 300, 3) == after).all()


def test_config(tmp_path):
    store = config.Store(str(tmp_path / "c.json"))
    assert store.load() == config.DEFAULTS and store.update("common", {"dpi": 99})["common"]["dpi"] == 99
    (tmp_path / "c.json").write_text("{broken")
    assert store.load() == config.DEFAULTS and (tmp_path / "c.broken.json").exists()
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "common": {"dpi": 77}, "modes": {"math": {"old": 1}}}))
    got = store.load()
    assert got["common"]["dpi"] == 77 and "old" not in got["modes"]["math"] and got["version"] == config.VERSION
    assert config.resolve_preset("odd", {"dpi": 50})["dpi"] == 50 and config.resolve_preset("safe", {"workers": 9})["workers"] == 1
    assert config.worker_count(0, 100, 8, 1000, 220) == 4 and config.worker_count(5, 2, 8, 9999, 1) == 2 and config.worker_count(0, 0, 1, 0, 220) == 1
    assert config.to_bool("Yes") and not config.to_bool("no") and config.to_number("x", 3, 0, 2) == 2 and config.parse_hsv("1,2, 3") == (1, 2, 3)
    assert config.frozen({"b": [1, {"c": 2}], "a": 1}) == config.frozen({"a": 1, "b": [1, {"c": 2}]})
    for bad in ("AUTO", "1,2", "200,1,1"):
        with pytest.raises(ValueError):
            config.parse_hsv(bad)


def test_job(spark, tmp_path):
    mark = "Licensed under CC BY-NC 4.0."
    pages = spark.createDataFrame([("a", i, f"lesson {i} text\n{mark}") for i in range(4)] + [("b", 9, "plain words only")], "document string, doc_id long, text string")
    job = process.Job()
    report = process.process(spark, pages, tables.lines(pages), f"file://{tmp_path}", "out", job=job)
    assert report["documents"] == 2 and report["removed"] == 4 and report["rejected"] == 0 and report["fallback"] == 1
    got = {r.doc_id: r.text for r in spark.read.parquet(report["output"]).collect()}
    assert got[0] == "lesson 0 text" and got[9] == "plain words only"
    new, last, ended = job.since(2)
    assert ended and last == len(job.events) and new[0]["id"] == 3 and [e["stage"] for e in job.events] == list(process.STAGES)
    again = process.process(spark, pages, tables.lines(pages), f"file://{tmp_path}", "out")
    assert again["backup"] == "out_backup"
    with pytest.raises(process.Cancelled):
        process.process(spark, pages, tables.lines(pages), f"file://{tmp_path}", "x", job=process.Job(should_cancel=lambda: True))
    assert files.load_signatures()[0]["id"] == "apache"


def test_measures_once(monkeypatch):
    """The pass works each measure of a page out once: three states of the page have content, whatever the number of steps."""
    page, _ = ruled()
    calls = {}
    for name in ("gray", "gaussian_blur", "components"):

        def counted(*args, f=getattr(K, name), name=name):
            calls[name] = calls.get(name, 0) + 1
            return f(*args)

        monkeypatch.setattr(K, name, counted)
    before = page.copy()
    R.clean(page)
    assert (page == before).all() and calls["gray"] <= 6 and calls.get("gaussian_blur", 0) <= 3 and calls["components"] <= 12
    facts = R.Facts(page)
    assert R.protect_mask(facts, R.Settings()) is R.protect_mask(facts, R.Settings())
    assert (R.protect_mask(facts, R.Settings(dark=30)) == R.protect_mask(page, R.Settings(dark=30))).all()


def _planted_measure(monkeypatch, name):
    from folioforge.plans import catalogue, page_kernels

    with monkeypatch.context() as m:
        m.setattr(page_kernels, "_planted", lambda spark, sf_dir, fields, measure: measure)
        return catalogue.QUERIES[name](None, None)


@pytest.mark.parametrize("name, most", [("planted_panels", 4), ("planted_table", 3)])
def test_planted_pages_are_measured_once(monkeypatch, name, most):
    measure, calls = _planted_measure(monkeypatch, name), []
    monkeypatch.setattr(K, "components", lambda mask, f=K.components: calls.append(1) or f(mask))
    measure(7)
    assert len(calls) <= most
