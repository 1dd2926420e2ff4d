"""Decision tables, samples, scores and gates on rows made here."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import analysis, jobs, qc, rasters, routing, sampling, streams
from folioforge.sources import files, tables


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("count, most, expected", [(20, 5, [0, 5, 10, 14, 19]), (3, 5, [0, 1, 2]), (9, 1, [0]), (0, 4, []), (1, 8, [0])])
def test_even_sample(spark, count, most, expected):
    assert _one(spark, sampling.even(F.lit(count), most)) == expected


def test_stages_are_nested(spark):
    for count in (1, 4, 7, 20, 101):
        three, five, eight = (set(_one(spark, c)) for c in sampling.staged(F.lit(count)))
        assert three <= five <= eight and len(three) == min(3, count)


def test_sample_needs_a_page():
    with pytest.raises(ValueError):
        sampling.even(F.lit(3), 0)


def test_early_stop(spark):
    rows = spark.createDataFrame(
        [("a", 0, 0.96, 0.97), ("a", 1, 0.99, 0.99), ("b", 0, 0.9, 0.9), ("b", 1, 0.9, 0.9), ("c", 0, 0.5, None), ("c", 1, 0.5, None), ("c", 2, 0.5, None)],
        "document string, stage int, confidence double, candidate_confidence double",
    )
    got = {r.document: r.stage for r in sampling.first_confident(rows, {0: (0.95, 0.95), 1: (0.90, 0.90)}).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("text, image, kind, sure", [(0.1, 0.9, "raster", 0.9), (0.9, 0.1, "vector", 0.9), (0.5, 0.5, "hybrid", 0.8), (0.2, 0.8, "raster", 0.8), (0.8, 0.15, "hybrid", 0.8)])
def test_classify(spark, text, image, kind, sure):
    k, c = analysis.classify(F.lit(text), F.lit(image))
    assert _one(spark, k) == kind and _one(spark, c) == pytest.approx(sure)


@pytest.mark.parametrize(
    "kind, image, doc, sure, repeated, strategy, confidence, strict",
    [
        ("raster", 0.9, 0.9, None, None, "raster_template", 0.85, True),
        ("raster", 0.9, 0.99, 0.97, False, "raster_template", 0.97, False),
        ("vector", 0.0, 0.9, None, None, "legacy", 0.69, False),
        ("vector", 0.0, 0.9, 0.6999, True, "legacy", 0.6999, False),
        ("vector", 0.0, 0.9, 0.70, True, "vector_remove", 0.70, True),
        ("vector", 0.0, 0.9, 0.95, True, "stream_remove", 0.95, False),
        ("vector", 0.0, 0.9, 0.95, False, "vector_remove", 0.95, True),
    ],
)
def test_plan(spark, kind, image, doc, sure, repeated, strategy, confidence, strict):
    rows = spark.createDataFrame(
        [("d", kind, doc, image, "m", repeated, sure)],
        "document string, kind string, confidence double, full_page_image_ratio double, marker string, repeated boolean, candidate_confidence double",
    )
    r = routing.plan(rows).first()
    assert (r.strategy, r.requires_strict_qc) == (strategy, strict) and r.plan_confidence == pytest.approx(confidence)
    assert routing.apply_preference(routing.plan(rows), "stream_clean").first().rejected == (strategy != "stream_remove")
    assert routing.apply_preference(routing.plan(rows), "compatibility_clean").first().strategy == "legacy"


def test_bad_choices(spark):
    with pytest.raises(ValueError):
        routing.check_profile("poetry")
    with pytest.raises(ValueError):
        routing.apply_preference(spark.createDataFrame([("x",)], "strategy string"), "fast")


def _score(spark, line, repeats, **scorer):
    rows = spark.createDataFrame([("d", line, repeats, 0)], "document string, line string, repeat_count long, first_doc long")
    return streams.scored(rows, streams.Scorer(**scorer)).first()


def test_scores(spark):
    r = _score(spark, "visit EXAMPLE.NET", 4, markers=("EXAMPLE.NET",))
    assert r.score == 65 + 18 + 18 + 10 and r.safe  # the hint is lower case, so no URL points
    r = _score(spark, "Chapter 1 EXAMPLE.NET", 1, markers=("EXAMPLE.NET",))
    assert not r.safe and r.score == 65 + 18 - 90
    r = _score(spark, "x" * 5001 + " marker", 1, markers=("marker",))
    assert not r.safe and r.score == 65
    assert _score(spark, "6d61726b6572", 1, markers=("marker",)).matched == ["marker"]
    r = _score(spark, "www.site.org", 2, markers=(), auto_detect=True)
    assert r.auto and r.score == 18 + 18 + 10 + 25 and r.safe


def test_remove_safe(spark):
    pages = spark.createDataFrame([("d", 1, "keep\nMARK\nend"), ("d", 2, "MARK"), ("e", 3, "MARK\nChapter 1 MARK")], "document string, doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in streams.remove_safe(pages, tables.lines(pages), streams.Scorer(("MARK",))).collect()}
    assert got == {1: ("keep\nend", 1), 2: ("", 1), 3: ("Chapter 1 MARK", 1)}


def test_preserved(spark):
    pages = spark.createDataFrame([("d", 1, "ab\nM-a R k!\ncd")], "document string, doc_id long, text string")
    r = streams.preserved(pages, ("Mark",)).first()
    assert (r.kept_chars, r.removed_chars) == (5, 8)


def test_numbered(spark):
    rows = spark.createDataFrame([("a", i) for i in (9000, 3, 4096, 4097)] + [("b", 1)], "document string, doc_id long")
    got = {(r.document, r.doc_id): r.page_index for r in tables.numbered(rows).collect()}
    assert got == {("a", 3): 0, ("a", 4096): 1, ("a", 4097): 2, ("a", 9000): 3, ("b", 1): 0}


def test_fold():
    assert T.fold_text("Crème — Brûlée!") == "cremebrulee" and T.fold_text("Straße") == "strasse" and T.fold_text("Straße", casefold=False) == "straße"
    assert T.parse_markers("# no\n a \n\nb") == ["a", "b"]


@pytest.mark.parametrize("value, expected", [("8%", 80), ("0.08", 80), ("120", 120), ("9999", 1000), ("x", 0), ("-3", 0), (None, 0)])
def test_edge_height(spark, value, expected):
    assert _one(spark, T.edge_height(F.lit(value).cast("string"), F.lit(1000))) == expected


def test_file_names(spark):
    assert _one(spark, T.safe_file_name(F.lit(" a/b?c "))) == "a_b_c.pdf"
    assert files.unique_name("a.pdf", {"a.pdf", "a_2.pdf"}) == "a_3.pdf"


def test_fingerprint(spark):
    base = "x" * 200_000
    prints = [_one(spark, analysis.fingerprint(F.lit(t))) for t in (base, "y" + base[1:], base[:-1] + "y", base[:100_000] + "y" + base[100_001:])]
    assert prints[0] != prints[1] and prints[0] != prints[2] and prints[0] == prints[3]


def test_verdict(spark):
    fields = "document string, page_count_ok boolean, geometry_ok boolean, outside_change_ratio double, residual double, footer_residual double, protected_change double"
    rows = [("a", True, True, None, None, None, None), ("b", False, True, 0.5, None, None, None), ("c", True, True, 0.08, 0.0801, None, None), ("d", True, True, 0.081, 0.0, 0.04, 0.003)]
    got = {r.document: (r.ok, r.reasons) for r in qc.verdict(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"a": (True, ""), "b": (False, "page_count"), "c": (False, "residual"), "d": (False, "footer_residual,protected_change,outside_change")}


def test_native_choice(spark):
    rows = spark.createDataFrame(
        [("d", 1, "i", 0, 0, 1, 1, 0.96), ("d", 1, "i", 0, 0, 1, 1, 0.96), ("d", 2, "i", 0, 0, 1, 1, 0.96), ("d", 2, "j", 0, 0, 1, 1, 0.5), ("d", 3, "i", 0, 0, 1, 1, 0.9)],
        "document string, page_id long, image string, x0 int, y0 int, x1 int, y1 int, coverage double",
    )
    assert [r.page_id for r in rasters.native_choice(rows).collect()] == [1]


def test_jobs(spark):
    log = spark.createDataFrame([(1, i, "processing" if i < 5 else "done") for i in range(6)] + [(2, 9, "queued")], "job_id long, event_id long, stage string").withColumn("percent", jobs.percent(F.col("stage")))
    assert {r.job_id: (r.n_events, r.last_event, r.terminal) for r in jobs.after(log, 3).collect()} == {1: (2, 5, True), 2: (1, 9, False)}
    assert sorted(r.event_id for r in jobs.retained(log, 2).where("job_id = 1").collect()) == [4, 5]
    assert [r.job_id for r in jobs.pruned(jobs.latest(log), 1).collect()] == [2]


def test_publish(spark, tmp_path):
    out = files.Publisher(spark, f"file://{tmp_path}")
    assert out.promote(out.stage(spark.range(1)), "t") is None
    staged = out.stage(spark.range(2))
    out.reject(staged)
    assert out.promote(out.stage(spark.range(3)), "t") == "t_backup" and out.promote(out.stage(spark.range(4)), "t") == "t_backup_2"
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("t", "t_backup", "t_backup_2")] == [4, 1, 3]


def test_discover(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.pdf", "a.pdf", "c.txt", "sub/d.pdf"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda r: sorted(x.path.rsplit("/", 1)[1] for x in files.discover(spark, str(tmp_path), recursive=r).select("path").collect())
    assert names(False) == ["a.pdf", "b.pdf"] and names(True) == ["a.pdf", "b.pdf", "d.pdf"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from folioforge.streaming import events

    batch = tables.table(spark, sf_dir, "events")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    log = events.log_stream(spark, f"{tmp_path}/in", 1)
    events.run_once(events.latest_state(log), "states", f"{tmp_path}/cp")
    assert sorted(spark.table("states").collect()) == sorted(jobs.latest(jobs.bound(batch)).collect())
