"""Queries of the page kernels on generated pages.

The stand-in rasters of the corpus hold no strokes, rules or overlays.  So pages are generated: each from the number of a row, by integer
arithmetic that SQL repeats.  Some SQL restates the operator pixel by pixel, on the same pages; other SQL states what was planted and
therefore must be found.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footer, guided, inkpages, kernels, ruledpages
from ..sources import tables
from . import process
from .catalogue import _EVEN, query

# ---- pages with an overlay that they share -------------------------------------------------------------------------
WIDTH, HEIGHT = 40, 30
_NOISE = "((7 * v + 13 * p + ((p * p) % 11) * (v % 5)) % 5 - 2)"
#: Gray of pixel p of page v: paper, a pale diagonal, and a dark line of letters elsewhere on each page.
_GRAY = f"CASE WHEN y = v % {HEIGHT} AND x % 4 < 2 THEN 34 + {_NOISE} WHEN abs(x + y - 46) <= 2 THEN 198 + {_NOISE} ELSE 236 + {_NOISE} END"


def overlay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document, page_id and pixels of one gray page for each row of ``embeddings``."""
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document"), F.col("vec_id").alias("page_id"), F.col("vec_id").alias("v"))
    gray = f"transform(transform(sequence(0L, {WIDTH * HEIGHT - 1}L), p -> struct(p AS p, p % {WIDTH} AS x, p div {WIDTH} AS y)), q -> {_GRAY})"
    head, arrow, body = gray.rpartition("q -> ")
    gray = head + arrow + re.sub(r"\b([pxy])\b", r"q.\1", body)
    pixels = F.unhex(F.array_join(F.transform(F.expr(gray), lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return rows.select("document", "page_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("channels"), pixels.alias("data"))


_NEAR = "nb AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))"
_WEIGHTS = "wt AS (SELECT o, exp(-(o * o) / (2 * 2.6::DOUBLE * 2.6)) / sum(exp(-(o * o) / (2 * 2.6::DOUBLE * 2.6))) OVER () AS g FROM range(-7, 8) t(o))"


def _mirror(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * (n - 1)} - ({i}) ELSE {i} END"


def _blur(source: str, value: str, key: str, out: str, height: int = HEIGHT, width: int = WIDTH) -> str:
    """A Gaussian of 15 pixels over a table of pixels, columns first."""
    return f"""{out}_v AS (SELECT a.{key}, a.x, a.y, sum(w.g * b.{value}) AS b FROM {source} a CROSS JOIN wt w JOIN {source} b ON b.{key} = a.{key} AND b.x = a.x AND b.y = {_mirror("a.y + w.o", height)} GROUP BY ALL),
{out} AS (SELECT a.{key}, a.x, a.y, sum(w.g * b.b) AS back FROM {out}_v a CROSS JOIN wt w JOIN {out}_v b ON b.{key} = a.{key} AND b.y = a.y AND b.x = {_mirror("a.x + w.o", width)} GROUP BY ALL)"""


def _spread(source: str, key: str, out: str, how: str) -> str:
    """Dilation (bool_or) or erosion (bool_and) by one pixel; beyond the page nothing counts."""
    return f"{out} AS (SELECT a.{key}, a.x, a.y, {how}(b.s) AS s FROM {source} a CROSS JOIN nb JOIN {source} b ON b.{key} = a.{key} AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL)"


_PIXELS = f"""SELECT CAST(label AS VARCHAR) AS document, vec_id AS page_id, x, y, {_GRAY} AS gray
 FROM (SELECT label, vec_id, vec_id AS v, p, p % {WIDTH} AS x, p // {WIDTH} AS y FROM {{rows}}, range({WIDTH * HEIGHT}) t(p))"""
_OVERLAY = f"""ev AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
sp AS (SELECT label, vec_id FROM ev WHERE list_contains({_EVEN.format(c="n", m=8)}, CAST(i AS INT))), {_WEIGHTS}, {_NEAR},
sx AS ({_PIXELS.format(rows="sp")}),
md AS (SELECT document, x, y, median(gray) AS med, count(*) AS samples FROM sx GROUP BY ALL HAVING count(*) >= 2),
mm AS (SELECT document, x, y, med, any_value(samples) AS samples, median(abs(gray - med)) AS mad FROM sx JOIN md USING (document, x, y) GROUP BY ALL),
{_blur("mm", "med", "document", "bk")},
co AS (SELECT document, x, y, mad <= 5.5 AND med BETWEEN 125 AND 246 AND back - med >= 4 AS s FROM mm JOIN bk USING (document, x, y)),
{_spread("co", "document", "c1", "bool_or")}, {_spread("c1", "document", "c2", "bool_and")}, {_spread("c2", "document", "mk", "bool_or")}"""


@query(f"""WITH {_OVERLAY} SELECT document, max(samples) AS n_samples, count(*) FILTER (s) AS n_mask, CAST(coalesce(sum(x + {WIDTH} * y) FILTER (s), 0) AS BIGINT) AS places,
round(CASE WHEN count(*) FILTER (s) = 0 THEN 0 ELSE least(0.98, 0.55 + 0.30 * greatest(0, 1 - avg(mad) FILTER (s) / 12) + 0.15 * least(1, count(*) FILTER (s) / {WIDTH * HEIGHT} / 0.02)) END, 6) AS confidence
FROM mk JOIN mm USING (document, x, y) GROUP BY 1""")
def shared_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of each document's overlay, learnt from its evenly sampled pages."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            masks = [np.flatnonzero(np.frombuffer(m, np.uint8)) for m in batch["mask"]]
            yield pd.DataFrame({
                "document": batch["document"], "n_samples": batch["n_samples"], "n_mask": [len(m) for m in masks],
                "places": [int(m.sum()) for m in masks], "confidence": batch["confidence"].round(6),
            })

    return kernels.learn_models(overlay_pages(spark, sf_dir)).mapInPandas(run, "document string, n_samples long, n_mask long, places long, confidence double")


_REPAIRED = f"""{_OVERLAY}, pg AS ({_PIXELS.format(rows="embeddings")}), dk AS (SELECT page_id, x, y, gray <= 105 AS s FROM pg), {_spread("dk", "page_id", "gd", "bool_or")}, {_blur("pg", "gray", "page_id", "pb")},
fx AS (SELECT pg.document, page_id, x, y, gray, pb.back, mk.s AS marked, CASE WHEN mk.s AND NOT gd.s THEN CAST(floor(greatest(0, least(255, greatest(pb.back + 4, gray + 24)))) AS INT) ELSE gray END AS fixed
 FROM pg JOIN pb USING (page_id, x, y) JOIN gd USING (page_id, x, y) JOIN mk ON mk.document = pg.document AND mk.x = pg.x AND mk.y = pg.y)""".replace("page_id, x, y, gray, pb.back", "pg.page_id, pg.x, pg.y, gray, pb.back")


@query(f"WITH {_REPAIRED} SELECT document, page_id, count(*) FILTER (fixed <> gray) AS changed, CAST(sum(fixed) AS BIGINT) AS total FROM fx GROUP BY ALL")
def overlay_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page repaired with its document's model."""
    return _repaired(spark, sf_dir, "changed long, total long", lambda page, mask, out, changed: (changed, int(out.astype(int).sum())))


@query(f"""WITH {_REPAIRED}, rs AS (SELECT document, page_id, count(*) FILTER (marked) AS candidates, count(*) FILTER (marked AND abs(fixed - gray) >= 3) AS acted,
 sum(greatest(0, least(255, trunc(back) - gray))) FILTER (marked AND abs(fixed - gray) >= 3) AS was, sum(greatest(0, least(255, trunc(back) - fixed))) FILTER (marked AND abs(fixed - gray) >= 3) AS rest FROM fx GROUP BY ALL)
SELECT document, page_id, acted, round(CASE WHEN acted = 0 THEN CASE WHEN candidates > 0 THEN 1.0 ELSE 0.0 END WHEN was = 0 THEN 0.0 ELSE least(1.0, rest / was) END, 6) AS residual FROM rs""")
def overlay_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the overlay's contrast to the paper the repair has left."""

    def measure(page, mask, out, changed):
        score = guided.residual(page, out, mask, kernels.paper(page.astype(float)))
        return int((mask & (abs(out.astype(int) - page) >= 3)).sum()), round(score, 6)

    return _repaired(spark, sf_dir, "acted long, residual double", measure)


def _repaired(spark: SparkSession, sf_dir: str, fields: str, measure) -> DataFrame:
    pages = overlay_pages(spark, sf_dir)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples():
                page = kernels.to_page(row)
                mask = np.frombuffer(row.mask, np.uint8).reshape(page.shape) > 0
                out.append((row.document, row.page_id, *measure(page, mask, *kernels.repair(page, mask))))
            yield pd.DataFrame(out, columns=["document", "page_id", *names])

    return pages.join(kernels.learn_models(pages).select("document", "mask"), "document").mapInPandas(run, f"document string, page_id long, {fields}")


_PLANS = "CASE CAST(label AS INT) % 3 WHEN 0 THEN 'raster_template' WHEN 1 THEN 'legacy' ELSE 'vector_remove' END"


@query(f"""WITH {_REPAIRED}, pn AS (SELECT DISTINCT CAST(label AS VARCHAR) AS document, {_PLANS} AS strategy FROM embeddings)
SELECT fx.document, page_id, CASE WHEN strategy = 'raster_template' THEN count(*) FILTER (fixed <> gray) ELSE 0 END AS changed, CASE WHEN strategy <> 'raster_template' THEN 'strategy ' || strategy ELSE '' END AS reason FROM fx JOIN pn ON pn.document = fx.document GROUP BY fx.document, page_id, strategy""")
def raster_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image documents under their plans: a repair with the document's model, or the page as it was and the reason."""
    plans = tables.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document"), F.expr(_PLANS).alias("strategy")).distinct()
    done = process.execute_rasters(overlay_pages(spark, sf_dir), plans)
    return done.select("document", "page_id", "changed", F.coalesce("reason", F.lit("")).alias("reason"))


# ---- pages on which something is planted ---------------------------------------------------------------------------
def _planted(spark: SparkSession, sf_dir: str, fields: str, measure) -> DataFrame:
    """``measure`` of each row's number; it makes a page and works on it."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(v, *measure(int(v))) for v in batch["vec_id"]], columns=["vec_id", *names])

    ids = tables.table(spark, sf_dir, "embeddings").select("vec_id")
    return ids.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id").mapInPandas(run, f"vec_id long, {fields}")


def _paper(height: int, width: int, gray: int = 250, channels: int = 3):
    import numpy as np

    return np.full((height, width, channels) if channels > 1 else (height, width), gray, np.uint8)


_RULE = "12 + vec_id % 9 AS spacing, 8 + vec_id % (4 + vec_id % 9) AS first"


@query(f"SELECT vec_id, CAST(spacing AS INT) AS spacing, 11 AS n_rules, CAST(first AS INT) AS first_rule, CAST(first + 10 * spacing AS INT) AS last_rule FROM (SELECT vec_id, {_RULE} FROM embeddings)")
def planted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of eleven ruled lines: its spacing and its first and last line are found."""

    def measure(v):
        spacing = 12 + v % 9
        first = 8 + v % (4 + v % 9)
        page = _paper(first + 10 * spacing + 9, 90)
        page[first : first + 10 * spacing + 1 : spacing] = 170
        centers, found = ruledpages.detect_centers(page, ruledpages.Settings())
        return found, len(centers), centers[0] if centers else -1, centers[-1] if centers else -1

    return _planted(spark, sf_dir, "spacing int, n_rules int, first_rule int, last_rule int", measure)


@query("SELECT vec_id, CAST(185 + vec_id % 20 AS INT) AS border, CAST(5 + (185 + vec_id % 20 - 82 - 10 - 1) // 20 + CASE WHEN (185 + vec_id % 20 - 82 - 10) % 20 > 0 AND 82 + 20 * ((185 + vec_id % 20 - 82 - 10 - 1) // 20 + 1) < 185 + vec_id % 20 - 10 THEN 1 ELSE 0 END AS INT) AS n_centers FROM embeddings")
def planted_footer_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest dark line of the page is the footer's border; a grid is continued down to it."""

    def measure(v):
        page = _paper(220, 100)
        page[165] = 40
        page[185 + v % 20] = 40
        border = ruledpages.footer_border(page, ruledpages.Settings())
        return border, len(ruledpages.extend_centers([2, 22, 42, 62, 82], border))

    return _planted(spark, sf_dir, "border int, n_centers int", measure)


_STROKES = "vec_id % 5 AS specks, 1 + vec_id % 3 AS strokes, 30 + vec_id % 10 AS span, 1 + vec_id % 2 AS thick"


@query(f"""SELECT vec_id, CAST(specks + strokes AS INT) AS n_components, CAST(strokes * span * thick AS INT) AS without_specks, CAST(CASE WHEN span >= 35 THEN strokes * span * thick ELSE 0 END AS INT) AS long_ones,
array_to_string(list_transform(range(strokes), lambda i: '5,' || (10 + 12 * i + thick // 2) || ',' || (5 + span) || ',' || thick), ';') AS segments FROM (SELECT vec_id, {_STROKES} FROM embeddings)""")
def planted_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specks and horizontal strokes: components, the mask without specks, the long strokes, the vector segments."""

    def measure(v):
        mask = _paper(60, 90, 0, 1) > 0
        for i in range(v % 5):
            mask[3 + 11 * i, 80] = True
        span, thick = 30 + v % 10, 1 + v % 2
        for i in range(1 + v % 3):
            mask[10 + 12 * i : 10 + 12 * i + thick, 5 : 5 + span] = True
        _, stats = kernels.components(mask)
        lines = inkpages.horizontal_lines(mask)
        return len(stats), int(ruledpages.drop_specks(mask, 5).sum()), int(ruledpages.keep_long(mask, 5, 35).sum()), ";".join(",".join(map(str, x)) for x in lines)

    return _planted(spark, sf_dir, "n_components int, without_specks int, long_ones int, segments string", measure)


_PATCH = "10 + vec_id % 7 AS x, 12 + vec_id % 5 AS y, 15 + vec_id % 6 AS w, 9 + vec_id % 4 AS h, 3 + vec_id % 20 AS gap"


@query(f"""SELECT vec_id, CAST(CASE WHEN gap <= 12 THEN 1 ELSE 2 END AS INT) AS n_boxes, CASE WHEN gap <= 12 THEN (x - 3) || ',' || (y - 3) || ',' || (x + w + gap + 20 + 3) || ',' || (y + h + 3)
ELSE (x - 3) || ',' || (y - 3) || ',' || (x + w + 3) || ',' || (y + h + 3) || ';' || (x + w + gap - 3) || ',' || (y - 3) || ',' || (x + w + gap + 20 + 3) || ',' || (y + h + 3) END AS boxes,
'hybrid' AS mode, CAST((w + 20 + 4) * (h + 2) AS INT) AS n_changed FROM (SELECT vec_id, {_PATCH} FROM embeddings)""")
def planted_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changed rectangles: the changed pixels, grown by one, and their boxes, united when they are close."""

    def measure(v):
        before = _paper(120, 160)
        after = before.copy()
        x, y, w, h, gap = 10 + v % 7, 12 + v % 5, 15 + v % 6, 9 + v % 4, 3 + v % 20
        after[y : y + h, x : x + w] = 200
        after[y : y + h, x + w + gap : x + w + gap + 20] = 200
        mask = inkpages.change_mask(before, after)
        boxes = inkpages.patch_boxes(mask)
        return len(boxes), ";".join(",".join(map(str, b)) for b in boxes), inkpages.choose_mode(mask, boxes), int(mask.sum())

    return _planted(spark, sf_dir, "n_boxes int, boxes string, mode string, n_changed int", measure)


@query("""WITH b AS (SELECT p_partkey, p_size, (p_partkey % 23) AS x, (p_partkey % 17) AS y, 20 + p_size AS w, 10 + p_partkey % 60 AS h FROM part)
SELECT p_partkey, w * h >= 0.12 * 100 * 140 AND w >= 45 AND h >= 35 AS seam, round(5 + x * 2.5, 4) AS px0, round(7 + y * 1.25, 4) AS py0, round(5 + (x + w) * 2.5, 4) AS px1, round(7 + (y + h) * 1.25, 4) AS py1 FROM b""")
def patch_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a patch's border would show on an image of 100 x 140 pixels, and the patch in points of a page of 250 x 175 from (5, 7)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples():
                box = (r.x, r.y, r.x + r.w, r.y + r.h)
                points = inkpages.to_points(box, (140, 100), (250.0, 175.0), (5.0, 7.0))
                out.append((r.p_partkey, inkpages.seam_risk([box], (140, 100)), *(round(p, 4) for p in points)))
            yield pd.DataFrame(out, columns=["p_partkey", "seam", "px0", "py0", "px1", "py1"])

    rows = tables.table(spark, sf_dir, "part").selectExpr("p_partkey", "int(p_partkey % 23) AS x", "int(p_partkey % 17) AS y", "20 + p_size AS w", "int(10 + p_partkey % 60) AS h")
    return rows.mapInPandas(run, "p_partkey long, seam boolean, px0 double, py0 double, px1 double, py1 double")


@query("SELECT vec_id, CAST(40 + vec_id % 30 AS INT) AS threshold, CAST((4 + vec_id % 9) * 80 * 255 + (60 - 4 - vec_id % 9) * 80 * 77 AS BIGINT) AS whitened FROM embeddings")
def planted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of a page of two gray levels is the darker one; white edges cover the rows asked for."""

    def measure(v):
        page = _paper(40, 40, 200 + v % 40, 1)
        page[10 : 14 + v % 7, 5:30] = 40 + v % 30
        edges = kernels.whiten_edges(_paper(60, 80, 77, 1), 4, v % 9)
        return inkpages.otsu(page), int(edges.astype(int).sum())

    return _planted(spark, sf_dir, "threshold int, whitened long", measure)


_BITS = """p8 AS (SELECT label AS document, vec_id AS page_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, greatest(0, least(255, CAST(round_even((CAST(embedding[i] AS DOUBLE) + 1) * 127.5, 0) AS INT))) > {level} AS s
 FROM embeddings, range(1, 65) t(i))"""


@query(f"""WITH {_BITS.format(level=130)}, {_NEAR}, {_spread("p8", "page_id", "d1", "bool_or")}, {_spread("p8", "page_id", "e1", "bool_and")}, {_spread("d1", "page_id", "cl", "bool_and")}, {_spread("e1", "page_id", "op", "bool_or")}
SELECT document, page_id, CAST(count(*) FILTER (p8.s) AS INT) AS n_set, CAST(count(*) FILTER (d1.s) AS INT) AS dilated, CAST(count(*) FILTER (e1.s) AS INT) AS eroded, CAST(count(*) FILTER (cl.s) AS INT) AS closed, CAST(count(*) FILTER (op.s) AS INT) AS opened
FROM p8 JOIN d1 USING (page_id, x, y) JOIN e1 USING (page_id, x, y) JOIN cl USING (page_id, x, y) JOIN op USING (page_id, x, y) GROUP BY ALL""")
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import _kernel_query

    def measure(page):
        m = page > 130
        return int(m.sum()), int(kernels.dilate(m).sum()), int(kernels.erode(m).sum()), int(kernels.close(m).sum()), int(kernels.opened(m).sum())

    return _kernel_query(spark, sf_dir, "n_set int, dilated int, eroded int, closed int, opened int", measure)


def _parts(level: int) -> str:
    return f"""{_BITS.format(level=level)}, on_ AS (SELECT page_id, x, y, x + 8 * y AS k FROM p8 WHERE s),
reach(page_id, a, b) AS (SELECT page_id, k, k FROM on_ UNION SELECT r.page_id, r.a, q.k FROM reach r JOIN on_ p ON p.page_id = r.page_id AND p.k = r.b JOIN on_ q ON q.page_id = p.page_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1),
part AS (SELECT page_id, a AS k, min(b) AS root FROM reach GROUP BY ALL), st AS (SELECT page_id, root, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM part JOIN on_ USING (page_id, k) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_parts(130)} SELECT label AS document, vec_id AS page_id, CAST(count(st.root) AS INT) AS n_components, CAST(coalesce(max(area), 0) AS INT) AS largest, CAST(coalesce(sum(area), 0) AS INT) AS area
FROM embeddings LEFT JOIN st ON st.page_id = vec_id GROUP BY ALL""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import _kernel_query

    def measure(page):
        _, stats = kernels.components(page > 130)
        return len(stats), int(stats[:, 4].max(initial=0)), int(stats[:, 4].sum())

    return _kernel_query(spark, sf_dir, "n_components int, largest int, area int", measure)


def _united(rounds: int) -> str:
    """Boxes united with all that they reach, a few times over: a united box may touch another one."""
    out = ["b0 AS (SELECT DISTINCT page_id, x0, y0, x1, y1 FROM st)"]
    for i in range(rounds):
        touch = "q.x0 <= p.x1 + 1 AND p.x0 <= q.x1 + 1 AND q.y0 <= p.y1 + 1 AND p.y0 <= q.y1 + 1"
        out.append(f"n{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x0, y0, x1, y1) AS k FROM b{i})")
        out.append(f"r{i}(page_id, a, b) AS (SELECT page_id, k, k FROM n{i} UNION SELECT r.page_id, r.a, q.k FROM r{i} r JOIN n{i} p ON p.page_id = r.page_id AND p.k = r.b JOIN n{i} q ON q.page_id = p.page_id AND {touch})")
        out.append(f"g{i} AS (SELECT page_id, a AS k, min(b) AS root FROM r{i} GROUP BY ALL)")
        out.append(f"b{i + 1} AS (SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g{i} JOIN n{i} USING (page_id, k) GROUP BY page_id, root)")
    return ", ".join(out)


@query(f"""WITH RECURSIVE {_parts(135)}, {_united(6)}, c AS (SELECT page_id, count(*) AS n FROM st GROUP BY 1), u AS (SELECT page_id, count(*) AS n, string_agg(x0 || ',' || y0 || ',' || x1 || ',' || y1, ';' ORDER BY x0, y0, x1, y1) AS boxes FROM b6 GROUP BY 1)
SELECT label AS document, vec_id AS page_id, CAST(coalesce(c.n, 0) AS INT) AS n_components, CAST(coalesce(u.n, 0) AS INT) AS n_boxes, coalesce(boxes, '') AS boxes FROM embeddings LEFT JOIN c ON c.page_id = vec_id LEFT JOIN u ON u.page_id = vec_id""")
def rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import _kernel_query

    def measure(page):
        _, stats = kernels.components(page > 135)
        boxes = kernels.merge_rects([(int(x), int(y), int(x + w - 1), int(y + h - 1)) for x, y, w, h, _ in stats], gap=1)
        return len(stats), len(boxes), ";".join(",".join(map(str, b)) for b in boxes)

    return _kernel_query(spark, sf_dir, "n_components int, n_boxes int, boxes string", measure)


_BLOBS = "1 + vec_id % 6 AS blobs, 200 + vec_id % 38 AS level"


@query(f"""SELECT vec_id, 'standard' AS level, CAST(blobs * 9 AS INT) AS changed, round(blobs * 9 * (250 - level) / (255.0::DOUBLE * 129 * 17), 6) AS score_before, 0.0::DOUBLE AS score_after, 0.0::DOUBLE AS protected_change
FROM (SELECT vec_id, {_BLOBS} FROM embeddings)""")
def planted_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footer with pale blobs, a rule, a coloured badge and a page number: exactly the blobs become paper."""

    def measure(v):
        import numpy as np

        page = np.empty((400, 300, 3), np.uint8)
        page[:] = (252, 250, 246)
        page[382, 24:276] = 70
        page[388:392, 250:270] = 30
        page[387:391, 200:204] = (220, 20, 20)
        page[100:110, 50:200] = 20
        for i in range(1 + v % 6):
            page[388:391, 104 + 14 * i : 107 + 14 * i] = 200 + v % 38
        _, m = footer.polish(page)
        return m["level"], m["changed"], round(m["score_before"], 6), round(m["score"], 6), m["protected_change"]

    return _planted(spark, sf_dir, "level string, changed int, score_before double, score_after double, protected_change double", measure)


def _colored(height: int, width: int):
    return _paper(height, width, 255)


@query("SELECT vec_id, CAST(4 * (10 + vec_id % 20) + 3 * (10 + vec_id % 7) AS INT) AS whitened, CAST(5 * (12 + vec_id % 9) AS INT) AS header_guard FROM embeddings")
def planted_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pale blocks in the header and the footer become white, dark ones and those elsewhere stay; header text at the right is guarded."""

    def measure(v):
        s = ruledpages.Settings()
        page = _colored(200, 300)
        page[2:6, 90 : 100 + v % 20] = 180 + v % 60
        page[192:195, 100 : 110 + v % 7] = 200
        page[100:110, 100:150] = 200
        page[7:9, 150:160] = 60
        out = ruledpages.clean_header_footer(page, s)
        right = _colored(200, 300)
        right[2:5, 250 : 260 + v % 9] = 140
        return int((out != page).any(2).sum()), int(ruledpages.header_right_guard(right, s).sum())

    return _planted(spark, sf_dir, "whitened int, header_guard int", measure)


@query("""SELECT vec_id, (30 + vec_id % 20) || ',40,100,' || (50 + vec_id % 10) || ',200,230,255' AS panels, CAST(5 * (30 + vec_id % 9) AS INT) AS given_back, CAST(4 * (20 + vec_id % 8) AS INT) AS recolored,
CAST(100 * (50 + vec_id % 10) AS INT) AS pale FROM embeddings""")
def planted_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coloured panel: its box and colour, a hole in it that is filled again, residue on it that takes its colour."""

    def measure(v):
        s = ruledpages.Settings()
        page = _colored(200, 200)
        x, h = 30 + v % 20, 50 + v % 10
        page[40 : 40 + h, x : x + 100] = (200, 230, 255)
        facts = ruledpages.Facts(page)
        _, found = ruledpages.panels(facts, s)
        hurt = page.copy()
        hurt[50:55, x + 10 : x + 40 + v % 9] = 255
        back = ruledpages.preserve_panels(facts, hurt, s)
        dirty = page.copy()
        dirty[60:64, x + 20 : x + 40 + v % 8] = (206, 233, 255)
        flat = ruledpages.recolor_flat_panels(dirty, s)
        boxes = ";".join(",".join(map(str, (*b[:4], *b[4]))) for b in found)
        differs = kernels.differs
        return boxes, int((differs(back, hurt) & ~differs(back, page)).sum()), int((differs(flat, dirty) & ~differs(flat, page)).sum()), int(ruledpages.pale_background(facts, s).sum())

    return _planted(spark, sf_dir, "panels string, given_back int, recolored int, pale int", measure)


@query("""SELECT vec_id, '21,31,' || (60 + vec_id % 10) || ',' || (30 + vec_id % 6) || ',220,240,210' AS cells, CAST(10 * (5 + vec_id % 5) AS INT) AS hurt, 0 AS left_over, 0 AS unprotected FROM embeddings""")
def planted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coloured cell within dark borders: its box and colour; what cleaning took of it comes back; all of it is protected."""

    def measure(v):
        s = ruledpages.Settings()
        page = _colored(120, 140)
        w, h = 60 + v % 10, 30 + v % 6
        page[30 : 32 + h, 20 : 22 + w] = 80
        page[31 : 31 + h, 21 : 21 + w] = (220, 240, 210)
        facts = ruledpages.Facts(page)
        cells = ruledpages.table_cells(facts, s)
        hurt = page.copy()
        hurt[35:45, 30 : 35 + v % 5] = 255
        fixed = ruledpages.clean_tables(facts, hurt, s)
        inside = ruledpages.table_protection(facts, s)[30 : 32 + h, 20 : 22 + w]
        text = ";".join(",".join(map(str, (*c[:4], *c[4]))) for c in cells)
        return text, int(kernels.differs(hurt, page).sum()), int(kernels.differs(fixed, page).sum()), int((~inside).sum())

    return _planted(spark, sf_dir, "cells string, hurt int, left_over int, unprotected int", measure)


@query("""WITH r AS (SELECT vec_id, 8 + vec_id % 6 AS n, 12 + vec_id % 8 AS gap FROM embeddings)
SELECT vec_id, CAST(n * (200 - gap) AS INT) AS evidence, CAST(n AS INT) AS centers, round(0.52::DOUBLE * (200 - gap) / 200 + 0.33 + 0.15 * least(1.0, n / 12.0::DOUBLE), 6) AS confidence, CAST(n * gap AS INT) AS bridged,
CAST(n * gap AS INT) AS drawn, 0 AS below_limit FROM r""")
def planted_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines with a gap each: the evidence, the confidence in the grid, the gaps that are bridged, and the lines drawn through them."""

    def measure(v):
        s = ruledpages.Settings()
        n, gap = 8 + v % 6, 12 + v % 8
        page = _paper(20 + 18 * n, 200)
        centers = list(range(10, 10 + 18 * n, 18))
        page[centers] = 200
        page[:, 90 : 90 + gap] = 250
        evidence = ruledpages.rule_evidence(page, s)
        good = ruledpages.filter_centers(centers, evidence, s)
        gate = ruledpages.bridge_gate(evidence, good, s)
        every = gate | True
        drawn = ruledpages.restore_rules(page, page, good, ruledpages.reconstruction_gate(0.9, gate, every, s), gate & False)
        low = ruledpages.reconstruction_gate(0.5, gate, every, s)
        return int(evidence.sum()), len(good), round(ruledpages.grid_confidence(good, evidence), 6), int(gate.sum()), int((drawn != page).any(2).sum()), int(low.sum())

    return _planted(spark, sf_dir, "evidence int, centers int, confidence double, bridged int, drawn int, below_limit int", measure)


@query("""SELECT vec_id, CAST((22 + vec_id % 15) * (14 + vec_id % 6) AS INT) AS removed, 384 AS protected, CAST(160 * 160 AS INT) AS graph_box, CAST(4 * (20 + vec_id % 20) + 319 AS INT) AS strokes_back,
CAST(30 * (1 + vec_id % 4) AS INT) AS text_guard FROM embeddings""")
def planted_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neutral block goes, ink stays; a graph's box and strokes are found; strokes are guarded and specks are not."""

    def measure(v):
        page = _colored(100, 120)
        page[10:20, 10:40] = 30
        page[50 : 62 + v % 6, 50 : 70 + v % 15] = 200
        _, meta = inkpages.clean(page)
        graph = _colored(200, 200)
        graph[100, 20:180] = 100
        graph[20:180, 100] = 100
        graph[40:44, 40 : 60 + v % 20] = (30, 60, 200)
        back = ruledpages.restore_graph(graph, _colored(200, 200), ruledpages.Settings())
        text = _colored(60, 120)
        for i in range(1 + v % 4):
            text[10:13, 10 + 20 * i : 20 + 20 * i] = 40
            text[40, 10 + 20 * i] = 40
        guard = ruledpages.text_guard(text, ruledpages.Settings())
        return meta["removed"], meta["protected"], int(inkpages.graph_roi(graph).sum()), int((back != 255).any(2).sum()), int(guard.sum())

    return _planted(spark, sf_dir, "removed int, protected int, graph_box int, strokes_back int, text_guard int", measure)


@query("""WITH s AS (SELECT vec_id, CAST(80 AS DOUBLE) AS w, CAST(100 + vec_id % 20 AS DOUBLE) AS h FROM embeddings), p AS (SELECT vec_id, w, h, x, y FROM s, range(80) a(x), range(120) b(y) WHERE y < h),
t AS (SELECT *, 0.85 * w AS dx, -0.85 * h AS dy, greatest(0.0, least(1.0, ((x - 0.1 * w) * (0.95 - 0.1) * w + (y - 0.95 * h) * (0.1 - 0.95) * h) / (pow((0.95 - 0.1) * w, 2) + pow((0.1 - 0.95) * h, 2)))) AS t FROM p),
d AS (SELECT vec_id, x, y, sqrt(pow(x - 0.1 * w - t * (0.95 - 0.1) * w, 2) + pow(y - 0.95 * h - t * (0.1 - 0.95) * h, 2)) <= 0.06 * least(w, h) AS inside FROM t)
SELECT vec_id, CAST(count(*) FILTER (inside) AS INT) AS band, CAST(count(*) FILTER (inside) AS INT) AS swept, CAST(count(*) FILTER (inside) AS INT) AS whitened, CAST(count(*) FILTER (inside) AS INT) AS hurt FROM d GROUP BY 1""")
def planted_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pale diagonal on white paper: the band, the swept pixels, the pixels that became white, and where lines may have been hurt."""

    def measure(v):
        s = ruledpages.Settings()
        page = _colored(100 + v % 20, 80)
        band = ruledpages.band_mask(page.shape[:2], s)
        page[band] = 210
        out, swept = ruledpages.clean_diagonal(page, s)
        return int(band.sum()), int(swept.sum()), int(((out == 255).all(2) & (page != 255).any(2)).sum()), int(ruledpages.damage_gate(swept, band).sum())

    return _planted(spark, sf_dir, "band int, swept int, whitened int, hurt int", measure)


# ---- kernels on the corpus's own 8x8 rasters
_SMALL = """px8 AS (SELECT label AS document, vec_id AS page_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, greatest(0, least(255, CAST(round_even((CAST(embedding[i] AS DOUBLE) + 1) * 127.5, 0) AS INT))) AS gray FROM embeddings, range(1, 65) t(i))"""


@query(f"""WITH {_SMALL}, {_WEIGHTS}, {_NEAR}, w8 AS (SELECT document, page_id, x, y, gray > 125 AS marked, CASE WHEN y = 0 THEN 255 ELSE gray END AS gray FROM px8),
dk AS (SELECT page_id, x, y, gray <= 105 AS s FROM w8), {_spread("dk", "page_id", "gd", "bool_or")}, {_blur("w8", "gray", "page_id", "pb", 8, 8)},
f AS (SELECT document, w8.page_id, gray, CASE WHEN marked AND NOT gd.s THEN CAST(floor(greatest(0, least(255, greatest(back + 4, gray + 24)))) AS INT) ELSE gray END AS fixed
 FROM w8 JOIN gd USING (page_id, x, y) JOIN pb USING (page_id, x, y))
SELECT document, page_id, CAST(count(*) FILTER (fixed <> gray) AS INT) AS changed, 'standard' AS level, 0.0::DOUBLE AS footer_score, CAST(sum(fixed) AS INT) AS total FROM f GROUP BY ALL""")
def legacy_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered page pass: white edge, repair under a mask, footer (of which so small a page has none)."""
    from .catalogue import _kernel_query

    def measure(page):
        out, m = kernels.clean_page(page, page > 125, top=1, bottom=0)
        return m["changed_pixels"], m["level"], m["footer_score"], int(out.astype(int).sum())

    return _kernel_query(spark, sf_dir, "changed int, level string, footer_score double, total int", measure)


@query(f"""WITH {_SMALL}, rm AS (SELECT document, page_id, y, avg(gray) AS mean FROM px8 GROUP BY ALL), bs AS (SELECT *, median(mean) OVER (PARTITION BY page_id) AS base FROM rm),
s AS (SELECT document, page_id, y, greatest(base - mean, 0) AS score FROM bs), t AS (SELECT page_id, avg(score) AS m, sum(score) AS total FROM s GROUP BY 1),
c AS (SELECT document, page_id, sp, ph, avg(score) AS m_on, sum(score) AS on_them, count(*) AS k FROM s, range(2, 5) a(sp), range(0, 4) b(ph) WHERE ph < sp AND y % sp = ph GROUP BY ALL),
v AS (SELECT document, page_id, sp, ph, (m_on - m) * least(1.0, k / 4.0) * on_them / greatest(total, 1e-9) AS value FROM c JOIN t USING (page_id)),
r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY round(value, 9) DESC, sp, ph) = 1)
SELECT document, page_id, CAST(CASE WHEN value > 1e-12 THEN sp ELSE 0 END AS INT) AS spacing, CAST(CASE WHEN value > 1e-12 THEN ph ELSE 0 END AS INT) AS phase, round(greatest(value, 0) + 1e-9, 6) AS score FROM r""")
def ruled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing and phase of the regular dark rows that explain a page best."""
    from .catalogue import _kernel_query

    def measure(page):
        spacing, phase, score = kernels.ruled_grid(page.mean(1), least=2, most=4)
        return spacing, phase, round(score + 1e-9, 6)  # no score lies between two roundings

    return _kernel_query(spark, sf_dir, "spacing int, phase int, score double", measure)


@query("""WITH r AS (SELECT vec_id, 10 + vec_id % 10 AS w, vec_id % 5 AS k, 1 + vec_id % 20 AS m, 100 + vec_id % 40 AS width FROM embeddings)
SELECT vec_id, round(k / w::DOUBLE, 6) AS dark_loss, round(k * 20 * 160 / 8000.0::DOUBLE, 6) AS mean_change, CAST(least(8, m) AS INT) AS n_samples, 50 AS sample_height, CAST(floor(width * 0.25::DOUBLE) AS INT) AS sample_width,
CAST(w + 4 AS INT) AS patch_width, 24 AS patch_height, 6 AS patch_kind FROM r""")
def planted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lost between two pages, the sample of a document's native images at working size, and a patch as PNG."""

    def measure(v):
        import struct

        before = _paper(80, 100)
        w, k = 10 + v % 10, v % 5
        before[30:50, 20 : 20 + w] = 40
        after = before.copy()
        after[30:50, 20 : 20 + k] = 200
        m = guided.page_metrics(before, after)
        picked = guided.sample_native([_paper(200, 100 + v % 40)] * (1 + v % 20), 8, 50)
        box = (18, 28, 22 + w, 52)
        mask = inkpages.change_mask(before, after)
        head = struct.unpack(">IIBB", inkpages.patch_png(after, mask, box)[16:26])
        return round(m["dark_loss"], 6), round(m["mean_change"], 6), len(picked), *picked[0].shape, head[0], head[1], head[3]

    return _planted(
        spark, sf_dir, "dark_loss double, mean_change double, n_samples int, sample_height int, sample_width int, patch_width int, patch_height int, patch_kind int", measure
    )
