"""Queries of the small rules: settings, names, markers, regions, safety checks, early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, guided, qc, rasters, sampling, settings
from ..sources import tables
from . import config, process
from .catalogue import _EVEN, _PG, _PROFILE, _PX, _SYM, MARKERS, REGISTRY, _marker_sql, _pages, _pixels, query

_text = tables.table


# ---- settings
_BOXES = "SELECT p_partkey, p_size, (p_partkey % 23) / 20.0::DOUBLE AS a, (p_partkey % 17) / 20.0::DOUBLE AS b, (p_partkey % 29) / 24.0::DOUBLE AS c, (p_partkey % 31) / 24.0::DOUBLE AS d FROM part"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda n, m: ((F.col("p_partkey") % n) / F.lit(m))
    return _text(spark, sf_dir, "part").select("p_partkey", "p_size", share(23, 20.0).alias("a"), share(17, 20.0).alias("b"), share(29, 24.0).alias("c"), share(31, 24.0).alias("d"))


_EDGES = "CASE p_partkey % 6 WHEN 0 THEN p_size || '%' WHEN 1 THEN '0.' || (10 + p_size) WHEN 2 THEN CAST(p_size * 3 AS VARCHAR) WHEN 3 THEN ' -' || p_size WHEN 4 THEN 'x' || p_size ELSE ' ' || p_size || '.7 ' END"


@query(f"""WITH v AS (SELECT p_partkey, 40 + p_size AS height, {_EDGES} AS value FROM part),
n AS (SELECT *, TRY_CAST(trim(regexp_replace(trim(value), '%$', '')) AS DOUBLE) AS number FROM v),
x AS (SELECT *, CASE WHEN trim(value) LIKE '%\\%' ESCAPE '\\' THEN height * number / 100 WHEN number > 0 AND number < 1 THEN height * number ELSE number END AS pixels FROM n)
SELECT p_partkey, value, CAST(CASE WHEN pixels IS NULL THEN 0 ELSE greatest(0, least(height, trunc(pixels))) END AS INT) AS edge FROM x""")
def edge_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text(spark, sf_dir, "part").select("p_partkey", (F.lit(40) + F.col("p_size")).alias("height"), F.expr(_EDGES.replace("VARCHAR", "STRING")).alias("value"))
    return rows.select("p_partkey", "value", T.edge_height(F.col("value"), F.col("height")).alias("edge"))


@query(f"""WITH b AS ({_BOXES}), r AS (SELECT p_partkey, 100 + p_size AS w, 140 + p_size AS h, a, b, c, d FROM b),
q AS (SELECT p_partkey, CAST(greatest(0, least(w, round_even(a * w, 0))) AS INT) AS x0, CAST(greatest(0, least(h, round_even(b * h, 0))) AS INT) AS y0,
 CAST(greatest(0, least(w, round_even(c * w, 0))) AS INT) AS x1, CAST(greatest(0, least(h, round_even(d * h, 0))) AS INT) AS y1 FROM r)
SELECT p_partkey, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE x0 END AS x0, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE y0 END AS y0,
CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE x1 END AS x1, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 0 ELSE y1 END AS y1 FROM q""")
def ratio_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = settings.ratio_box([F.col(c) for c in "abcd"], F.lit(100) + F.col("p_size"), F.lit(140) + F.col("p_size"))
    return _boxes(spark, sf_dir).select("p_partkey", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])


@query("""WITH o AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Yes ' WHEN 1 THEN 'on' WHEN 2 THEN '0' WHEN 3 THEN ' TRUE' ELSE p_brand END AS flag,
CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ' 12.5' WHEN 2 THEN 'nan' ELSE p_type END AS value,
CASE p_partkey % 4 WHEN 0 THEN p_size * 5 || ', 10,20' WHEN 1 THEN '7,300,1' WHEN 2 THEN 'AUTO' ELSE ' 1 ,2 , 3 ' END AS bound FROM part)
SELECT p_partkey, lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 'on') AS flag,
greatest(2.0, least(30.0, CASE WHEN TRY_CAST(trim(value) AS DOUBLE) IS NULL OR isnan(TRY_CAST(trim(value) AS DOUBLE)) THEN 5.0 ELSE TRY_CAST(trim(value) AS DOUBLE) END))::DOUBLE AS number,
CASE WHEN regexp_full_match(bound, '\\s*\\d+\\s*,\\s*\\d+\\s*,\\s*\\d+\\s*') AND TRY_CAST(trim(split_part(bound, ',', 1)) AS INT) BETWEEN 0 AND 179 AND TRY_CAST(trim(split_part(bound, ',', 2)) AS INT) BETWEEN 0 AND 255 AND TRY_CAST(trim(split_part(bound, ',', 3)) AS INT) BETWEEN 0 AND 255
 THEN trim(split_part(bound, ',', 1)) || '/' || trim(split_part(bound, ',', 2)) || '/' || trim(split_part(bound, ',', 3)) END AS hsv FROM o""")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, clamped numbers and colour bounds from texts."""
    rows = _text(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'Yes ' WHEN 1 THEN 'on' WHEN 2 THEN '0' WHEN 3 THEN ' TRUE' ELSE p_brand END AS flag",
        "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN ' 12.5' WHEN 2 THEN 'nan' ELSE p_type END AS value",
        "CASE p_partkey % 4 WHEN 0 THEN p_size * 5 || ', 10,20' WHEN 1 THEN '7,300,1' WHEN 2 THEN 'AUTO' ELSE ' 1 ,2 , 3 ' END AS bound",
    )
    return rows.select(
        "p_partkey", settings.boolean(F.col("flag")).alias("flag"), settings.number(F.col("value"), 5.0, 2.0, 30.0).alias("number"),
        F.array_join(F.transform(settings.hsv(F.col("bound")), lambda x: x.cast("string")), "/").alias("hsv"),
    )


@query("""WITH r AS (SELECT n_nationkey, n_nationkey % 7 AS requested, n_nationkey * 3 AS pages, 1 + n_nationkey % 9 AS cores, n_nationkey * 517 AS free, 60 + n_nationkey * 17 AS dpi, n_nationkey % 4 AS cap,
 CASE n_nationkey % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'quality' WHEN 2 THEN 'odd' WHEN 3 THEN 'balanced' ELSE 'fast' END AS preset FROM nation),
m AS (SELECT *, CAST(floor(greatest(220.0, 8.5 * 11.7 * greatest(72, dpi) * greatest(72, dpi) * 3 / 1048576.0::DOUBLE * 7.5 + 140)) AS INT) AS megabytes FROM r)
SELECT n_nationkey, megabytes, CAST(greatest(1, least(CASE WHEN requested > 0 THEN requested WHEN cores > 2 THEN cores - 1 ELSE cores END, greatest(1, pages), cores, greatest(1, free // megabytes), CASE WHEN cap > 0 THEN cap ELSE cores END)) AS INT) AS workers FROM m""")
def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_nationkey")
    rows = _text(spark, sf_dir, "nation").select("n_nationkey", settings.megabytes(60 + c * 17).alias("megabytes"))
    return rows.select("n_nationkey", "megabytes", settings.workers(c % 7, c * 3, 1 + c % 9, c * 517, F.col("megabytes"), c % 4).alias("workers"))


_PRESET = lambda key: " ".join(f"WHEN '{n}' THEN {v.get(key, 'NULL')}" for n, v in config.PRESETS.items())
_NAMES = "CASE n_nationkey % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'quality' WHEN 2 THEN 'odd' WHEN 3 THEN 'balanced' ELSE 'fast' END"


@query(f"""WITH r AS (SELECT n_nationkey, {_NAMES} AS name, CASE WHEN n_nationkey % 3 = 0 THEN 100 + n_nationkey END AS given FROM nation)
SELECT n_nationkey, CAST(coalesce(given, CASE name {_PRESET("dpi")} ELSE {config.PRESETS["balanced"]["dpi"]} END) AS INT) AS dpi, CAST(CASE WHEN name = 'safe' THEN 1 ELSE coalesce(given, 0) END AS INT) AS workers,
CASE WHEN name IN ({", ".join(f"'{n}'" for n in config.PRESETS)}) THEN name ELSE 'balanced' END AS preset FROM r""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution, workers (0: as many as there is room for) and name of presets."""
    rows = _text(spark, sf_dir, "nation").select("n_nationkey", F.expr(_NAMES).alias("name"), F.when(F.col("n_nationkey") % 3 == 0, 100 + F.col("n_nationkey")).alias("given"))
    own = F.when(F.col("name").isin(*config.PRESETS), F.col("name")).otherwise("balanced")
    values = [F.coalesce(settings.preset(F.col("name"), k, F.col("given")).cast("int"), F.lit(0)).alias(k) for k in ("dpi", "workers")]
    return rows.select("n_nationkey", *values, own.alias("preset"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'math' WHEN 'de' THEN 'physics' WHEN 'fr' THEN 'chemistry' END AS profile,
CASE lang WHEN 'en' THEN 'toan' WHEN 'de' THEN 'ly' WHEN 'fr' THEN 'hoa' END AS mode FROM documents""")
def legacy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content profiles (an unknown name is refused) and the older engine's modes."""
    named = F.when(F.col("lang") == "en", "math").when(F.col("lang") == "de", "physics").when(F.col("lang") == "fr", "chemistry").otherwise(F.col("lang"))
    return _text(spark, sf_dir, "documents").select("doc_id", settings.content_profile(named).alias("profile"), settings.legacy_mode(named).alias("mode"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) || '.pdf' AS name FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS i FROM h)
SELECT page_id, CASE WHEN i = 1 THEN name ELSE regexp_replace(name, '\\.pdf$', '') || '_' || i || '.pdf' END AS output FROM r""")
def unique_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs that would meet: the second gets ``_2``.  A name's rows are numbered in blocks of ids, so no task sorts all of them."""
    rows = _text(spark, sf_dir, "pages").select(F.concat(tables.host("url"), F.lit(".pdf")).alias("document"), F.col("page_id").alias("doc_id"))
    i, stem = F.col("page_index") + 1, F.regexp_replace("document", r"\.pdf$", "")
    return tables.numbered(rows).select(F.col("doc_id").alias("page_id"), F.when(i == 1, F.col("document")).otherwise(F.concat(stem, F.lit("_"), i.cast("string"), F.lit(".pdf"))).alias("output"))


# ---- texts and markers
@query("""SELECT conv_id, turn, CAST(len(m) AS INT) AS n_markers, sha256(array_to_string(m, '|')) AS markers_sha256 FROM (SELECT conv_id, turn,
list_filter(list_transform(string_split(replace(text, '. ', chr(10) || ' # ') || chr(10) || '  ', chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS m FROM conversations)""")
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker lines of settings texts; every sentence but the first is made a comment."""
    made = F.concat(F.replace("text", F.lit(". "), F.lit("\n # ")), F.lit("\n  "))
    rows = _text(spark, sf_dir, "conversations").select("conv_id", "turn", T.markers_of(made).alias("m"))
    return rows.select("conv_id", "turn", F.size("m").alias("n_markers"), F.sha2(F.array_join("m", "|"), 256).alias("markers_sha256"))


@query("SELECT doc_id, strlen(text) AS n_letters, contains(text, 'é') AS has_accent FROM documents")
def latin1_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read as Latin-1: two bytes of one letter are two letters, and a marker is found by its bytes."""
    rows = _text(spark, sf_dir, "documents").select("doc_id", T.latin1(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_letters"), F.col("t").contains("Ã©").alias("has_accent"))


@query(f"SELECT doc_id, array_to_string((list_filter([{', '.join(f'CASE WHEN {_marker_sql('text', m)} THEN {chr(39)}{m}{chr(39)} END' for m in MARKERS)}], lambda x: x IS NOT NULL))[1:3], ';') AS markers FROM documents")
def first_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three markers that occur, in the order of the registry."""
    return _text(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.matched(F.col("text"), list(MARKERS)), 1, 3), ";").alias("markers"))


_REGION = " UNION ALL ".join(
    f"SELECT document, list_transform(list_filter(range(1, length(line) - {len(a) - 1} + 1), lambda i: substr(line, i, {len(a)}) = '{a}'), lambda i: [greatest(0, i - 1 - 4), least(length(line), i - 1 + {len(a)} + 4), length(line)]) AS r FROM ln WHERE contains(line, '{a}')"
    for a in MARKERS
)


@query(f"""WITH ln AS (SELECT source AS document, unnest(string_split(text, chr(10))) AS line FROM documents), f AS ({_REGION}), u AS (SELECT document, unnest(r) AS r FROM f),
d AS (SELECT DISTINCT document, round(r[1] / greatest(1, r[3]), 5) AS x0, round(r[2] / greatest(1, r[3]), 5) AS x1 FROM u)
SELECT document, x0, x1 FROM d""")
def alias_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where aliases stand in their lines, padded by four letters, as shares of the line; each region once."""
    lines = _pages(spark, sf_dir).select("document", F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line")

    def padded(alias: str):
        return F.transform(T.occurrences(F.col("line"), alias), lambda i: F.struct(F.greatest(F.lit(0), i - 5).alias("a"), F.least(n, i + len(alias) + 3).alias("b")))

    spots = [padded(a) for a in MARKERS]
    rows = lines.where(T.any_of(F.col("line"), MARKERS)).select("document", n.alias("n"), F.explode(F.flatten(F.array(*spots))).alias("r"))
    share = lambda c: F.round(F.col(f"r.{c}") / F.greatest(F.lit(1), F.col("n")), 5)
    return rows.select("document", share("a").alias("x0"), share("b").alias("x1")).distinct()


@query(f"""WITH {_PX}, g AS (SELECT document, page_id, gray, pixel % 8 AS x, pixel // 8 AS y, (page_id % 9) / 8.0::DOUBLE AS a, (page_id % 7) / 8.0::DOUBLE AS b, 1.2 - (page_id % 5) / 4.0::DOUBLE AS c, (page_id % 11) / 10.0::DOUBLE AS d FROM px),
k AS (SELECT *, (x >= round_even(least(a, greatest(0, least(1, c))) * 8, 0) AND x < round_even(greatest(a, greatest(0, least(1, c))) * 8, 0) AND y >= round_even(least(b, d) * 8, 0) AND y < round_even(greatest(b, d) * 8, 0)) OR (page_id % 2 = 0 AND x >= 6 AND y >= 6) AS ok FROM g)
SELECT document, page_id, count(*) FILTER (ok) AS n_allowed, CAST(coalesce(sum(gray) FILTER (NOT ok), 0) AS BIGINT) AS outside_gray FROM k GROUP BY ALL""")
def allowed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the union of regions: corners in any order, values beyond the page clamped, a malformed region skipped."""
    p = F.col("page_id")
    first = F.array((p % 9) / 8.0, (p % 7) / 8.0, F.lit(1.2) - (p % 5) / 4.0, (p % 11) / 10.0)
    second = F.when(p % 2 == 0, F.array(*map(F.lit, (0.75, 0.75, 1.0, 1.0)))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    rows = _pixels(spark, sf_dir).withColumn("regions", F.array(settings.region_pixels(first, 8, 8), settings.region_pixels(second, 8, 8)))
    ok = settings.allowed(F.col("regions"), F.col("pixel") % 8, F.floor(F.col("pixel") / 8))
    return rows.groupBy("document", "page_id").agg(F.count_if(ok).alias("n_allowed"), F.coalesce(F.sum(F.when(~ok, F.col("gray"))), F.lit(0)).cast("long").alias("outside_gray"))


# ---- pages
@query("""WITH p AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, page_id, strlen(html) AS area, unnest(regexp_extract_all(html, '(?s)<article>.*?</article>')) AS f FROM pages),
d AS (SELECT DISTINCT document, page_id, sha256(f) AS image, least(1.0, strlen(f) * 1.4 / area) AS coverage FROM p)
SELECT document, page_id, min(image) AS image, round(max(coverage), 6) AS coverage FROM d GROUP BY ALL HAVING count(*) = 1 AND max(coverage) >= 0.95""")
def native_image_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with exactly one different placement that covers them; articles stand in for images, bytes for areas."""
    rows = _text(spark, sf_dir, "pages").select(
        tables.host("url").alias("document"), "page_id", F.octet_length("html").alias("area"), F.explode(F.regexp_extract_all("html", F.lit("(?s)<article>.*?</article>"), F.lit(0))).alias("f")
    )
    box = {c: F.lit(0) for c in ("x0", "y0", "x1", "y1")}
    placed = rows.withColumns({"image": F.sha2("f", 256), "coverage": F.least(F.lit(1.0), F.octet_length("f") * F.lit(14.0) / 10 / F.col("area")), **box})
    # The share is that of the exact decimal 1.4, as a page may stand exactly on the limit; ties of the rounding are those of the scaled value.
    return rasters.native_choice(placed).select("document", "page_id", "image", (F.round(F.col("coverage") * 1e6) / 1e6).alias("coverage"))


@query("""WITH p AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, page_id, CASE WHEN page_id % 37 = 0 THEN 90 ELSE 0 END AS rotation, len(regexp_extract_all(html, '<div class="ad">')) AS notes,
 regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS chars, (page_id % 10) / 9.0::DOUBLE AS coverage FROM pages),
r AS (SELECT document, page_id, CASE WHEN rotation <> 0 THEN 'rotation' WHEN notes > 0 THEN 'annotations' WHEN len(list_filter(links, lambda u: NOT contains(lower(u), '/'))) > 0 THEN 'links' WHEN chars > 20 THEN 'text' WHEN coverage < 0.95 THEN 'image' END AS reason FROM p)
SELECT document, page_id, reason FROM r WHERE reason IS NOT NULL""")
def unsafe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may not be rebuilt as one image, with the first reason.  Advertisements stand in for annotations; titles of up to 20 letters count as no text."""
    p = F.col("page_id")
    chars = F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = _text(spark, sf_dir, "pages").select(
        tables.host("url").alias("document"), "page_id", F.when(p % 37 == 0, 90).otherwise(0).alias("rotation"), F.regexp_count("html", F.lit('<div class="ad">')).alias("n_annotations"),
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("links"), F.when(chars > 20, chars).otherwise(0).alias("n_chars"), ((p % 10) / 9.0).alias("coverage"),
    )
    return guided.unsafe_pages(rows, ("/",))


@query("SELECT p_partkey, CAST(least(1500 + p_size, greatest(1, round_even(p_retailprice * 150 / 72, 0))) AS INT) AS side FROM part")
def work_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side of the working image: the page at 150 dpi, never above the native image."""
    return _text(spark, sf_dir, "part").select("p_partkey", guided.work_side(F.lit(1500) + F.col("p_size"), F.col("p_retailprice"), 150).alias("side"))


@query("""WITH p AS (SELECT vec_id, greatest(0, least(255, CAST(round_even((CAST(embedding[1] AS DOUBLE) + 1) * 127.5, 0) AS INT))) AS r, greatest(0, least(255, CAST(round_even((CAST(embedding[2] AS DOUBLE) + 1) * 127.5, 0) AS INT))) AS g,
greatest(0, least(255, CAST(round_even((CAST(embedding[3] AS DOUBLE) + 1) * 127.5, 0) AS INT))) AS b FROM embeddings) SELECT vec_id, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS INT) AS gray FROM p""")
def gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.bround((F.element_at("embedding", i).cast("double") + 1) * 127.5, 0).cast("int")))
    return _text(spark, sf_dir, "embeddings").select("vec_id", rasters.luma(channel(1), channel(2), channel(3)).cast("int").alias("gray"))


_PRIOR = "(x >= 0.42 * w AND y >= 0.42 * h AND abs((0.52 - 0.98) * h * (x - 0.50 * w) - (0.98 - 0.50) * w * (y - 0.98 * h)) / sqrt(pow((0.52 - 0.98) * h, 2) + pow((0.98 - 0.50) * w, 2)) <= greatest(10.0, 0.11 * least(w, h)))"


@query(f"""WITH s AS (SELECT DISTINCT label, CAST(160 + 7 * label AS DOUBLE) AS w, CAST(120 + 10 * label AS DOUBLE) AS h FROM embeddings),
p AS (SELECT label, w, h, x, y FROM s, range(300) a(x), range(300) b(y) WHERE x < w AND y < h)
SELECT label, count(*) FILTER {_PRIOR.replace("(x >=", "(WHERE x >=", 1)} AS n_pixels, CAST(sum(x + 1000 * y) FILTER {_PRIOR.replace("(x >=", "(WHERE x >=", 1)} AS BIGINT) AS places FROM p GROUP BY 1""")
def diagonal_prior_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the page in which the known overlay is looked for, for pages of several shapes."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for label in batch["label"]:
                y, x = np.nonzero(guided.diagonal_prior((120 + 10 * label, 160 + 7 * label)))
                out.append((label, len(x), int((x + 1000 * y).sum())))
            yield pd.DataFrame(out, columns=["label", "n_pixels", "places"])

    return _text(spark, sf_dir, "embeddings").select("label").distinct().mapInPandas(run, "label int, n_pixels long, places long")


@query(f"""WITH {_PX}, rm AS (SELECT document, page_id, CAST(pixel // 8 AS INT) AS y, avg(gray) AS mean FROM px GROUP BY ALL), s AS (SELECT *, mean < avg(mean) OVER (PARTITION BY document, page_id) AS strong FROM rm),
g AS (SELECT document, page_id, y, y - row_number() OVER (PARTITION BY document, page_id ORDER BY y) AS island FROM s WHERE strong)
SELECT document, page_id, min(y) AS first_row, max(y) AS last_row FROM g GROUP BY document, page_id, island QUALIFY row_number() OVER (PARTITION BY document, page_id ORDER BY island DESC) = 1""")
def footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest group of neighbouring rows that are darker than the page."""
    rows = rasters.row_means(_pixels(spark, sf_dir))
    page = rows.groupBy("document", "page_id").agg(F.avg("mean").alias("level"))
    return rasters.lowest_group(rows.join(page, ["document", "page_id"]).where("mean < level"))


# ---- checks and stages
@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Off' WHEN 1 THEN 'quick' WHEN 2 THEN 'FULL' WHEN 3 THEN 'other' END AS mode, value FROM events)
SELECT event_id, CASE WHEN lower(trim(mode)) IN ('full', 'quick', 'off') THEN lower(trim(mode)) ELSE 'full' END AS mode, CASE WHEN lower(trim(mode)) = 'off' THEN true ELSE coalesce(value / 1000 <= 0.08, true) END AS ok,
CASE WHEN lower(trim(mode)) = 'off' OR coalesce(value / 1000 <= 0.08, true) THEN '' ELSE 'outside_change' END AS reasons FROM r""")
def qc_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts under the settings: ``off`` passes everything unseen, an unknown mode is ``full``."""
    e = F.col("event_id") % 5
    mode = F.when(e == 0, " Off").when(e == 1, "quick").when(e == 2, "FULL").when(e == 3, "other")
    absent = F.lit(None).cast("double")
    rows = _text(spark, sf_dir, "events").select("event_id", settings.qc_mode(mode).alias("mode"), (F.col("value") / 1000).alias("outside_change_ratio")).withColumns(
        {"page_count_ok": F.lit(True), "geometry_ok": F.lit(True), "residual": absent, "footer_residual": absent, "protected_change": absent}
    )
    return qc.under_mode(qc.verdict(rows), "mode").select("event_id", "mode", "ok", "reasons")


_STAGE_LISTS = f"""c AS (SELECT source AS document, count(*) AS n FROM documents GROUP BY 1),
a AS (SELECT document, n, {_EVEN.format(c="n", m=8)} AS s8 FROM c), b AS (SELECT *, list_transform({_EVEN.format(c="len(s8)", m=5)}, lambda i: s8[i + 1]) AS s5 FROM a),
d AS (SELECT *, list_transform({_EVEN.format(c="len(s5)", m=3)}, lambda i: s5[i + 1]) AS s3 FROM b),
st AS (SELECT document, 3 AS stage, unnest(s3) AS page_index FROM d UNION ALL SELECT document, 5, unnest(s5) FROM d UNION ALL SELECT document, 8, unnest(s8) FROM d)"""


@query(f"""WITH {_STAGE_LISTS}, pi AS (SELECT source AS document, doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_index FROM documents),
ra AS (SELECT st.document, stage, avg(CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END) AS tr, avg({_SYM}) AS ir, count(*) AS n_pages FROM st JOIN pi USING (document, page_index) GROUP BY ALL),
pf AS (SELECT *, CASE WHEN ir >= 0.8 AND tr <= 0.2 THEN 'raster' WHEN tr >= 0.8 AND ir < 0.15 THEN 'vector' ELSE 'hybrid' END AS kind,
  CASE WHEN ir >= 0.8 AND tr <= 0.2 THEN greatest(ir, 1 - tr) WHEN tr >= 0.8 AND ir < 0.15 THEN greatest(tr, 1 - ir) ELSE 0.8 END AS confidence, ir * 60 AS sure FROM ra),
en AS (SELECT *, (stage = 3 AND confidence >= 0.95 AND sure >= 0.95) OR (stage = 5 AND confidence >= 0.90 AND sure >= 0.90) AS enough FROM pf)
SELECT document, stage, n_pages, kind, round(confidence, 6) AS confidence FROM en QUALIFY row_number() OVER (PARTITION BY document ORDER BY NOT enough, CASE WHEN enough THEN stage ELSE -stage END) = 1""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first staged sample whose profile is sure enough, else the largest; symbols stand in for the candidate's confidence."""
    rows = analysis.staged_profiles(_pages(spark, sf_dir)).withColumn("candidate_confidence", F.col("full_page_image_ratio") * 60)
    best = sampling.first_confident(rows, sampling.NEEDED)
    return best.select("document", "stage", F.col("page_count").alias("n_pages"), "kind", F.round("confidence", 6).alias("confidence"))


_STAGED = "pg AS (SELECT st.document || '#' || stage AS document, doc_id, text FROM st JOIN pi ON pi.document = st.document AND pi.page_index = st.page_index)"


@query(f"""WITH {_STAGE_LISTS}, pi AS (SELECT source AS document, doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_index FROM documents),
{_PROFILE.replace(_PG, _STAGED)}, sg AS (SELECT split_part(rt.document, '#', 1) AS document, CAST(split_part(rt.document, '#', 2) AS INT) AS stage, rt.kind, rt.confidence, rt.marker, sure, page_count FROM rt JOIN pf ON pf.document = rt.document),
en AS (SELECT *, coalesce((stage = 3 AND confidence >= 0.95 AND sure >= 0.95) OR (stage = 5 AND confidence >= 0.90 AND sure >= 0.90), false) AS enough FROM sg)
SELECT document, stage, page_count, kind, round(confidence, 6) AS confidence, marker, round(sure, 6) AS candidate_confidence FROM en QUALIFY row_number() OVER (PARTITION BY document ORDER BY NOT enough, CASE WHEN enough THEN stage ELSE -stage END) = 1""")
def staged_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of the document job: profile and best candidate of the first sure sample."""
    rows = process.analyze_staged(_pages(spark, sf_dir), REGISTRY)
    return rows.select("document", "stage", "page_count", "kind", F.round("confidence", 6).alias("confidence"), "marker", F.round("candidate_confidence", 6).alias("candidate_confidence"))
