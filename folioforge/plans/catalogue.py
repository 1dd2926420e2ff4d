"""The query catalogue: every query of this library with its SQL counterpart where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, guided, inkpages, jobs, kernels, qc, rasters, routing, ruledpages, sampling, streams
from ..sources import files, tables
from ..session import shared_dir
from ..streaming import events
from . import process

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


REGISTRY = files.load_signatures()
MARKERS = tuple(a for s in REGISTRY for a in s["aliases"])
SCORER = streams.Scorer(markers=MARKERS)
AUTO = streams.Scorer(markers=(), auto_detect=True)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_pages(tables.table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(_pages(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rasters(tables.table(spark, sf_dir, "embeddings"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.bound(tables.table(spark, sf_dir, "events"))


# ---- SQL building blocks -------------------------------------------------------------------------------------------
_PG = "pg AS (SELECT source AS document, doc_id, text FROM documents)"
_LN = f"{_PG}, ln AS (SELECT document, doc_id, line FROM (SELECT document, doc_id, unnest(string_split(text, chr(10))) AS line FROM pg) WHERE trim(line) <> '')"
_PX = """px AS (SELECT label AS document, vec_id AS page_id, p - 1 AS pixel,
  greatest(0, least(255, CAST(round_even((CAST(embedding[p] AS DOUBLE) + 1) * 127.5, 0) AS INT))) AS gray
  FROM embeddings, unnest(generate_series(1, 64)) AS t(p))"""
_LOG = """lg AS (SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS stage FROM events),
log AS (SELECT *, CASE stage WHEN 'queued' THEN 0.0 WHEN 'analyzing' THEN 28.0 WHEN 'processing' THEN 58.0 ELSE 100.0 END::DOUBLE AS percent FROM lg)"""


def _any(column: str, literals) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in literals) + ")" if literals else "false"


def _marker_sql(column: str, m: str) -> str:
    return f"(contains({column}, '{m}') OR contains(lower({column}), '{m.lower()}') OR contains(lower({column}), '{m.encode().hex()}'))"


def _scored_sql(scorer: streams.Scorer) -> str:
    hit = "(" + " OR ".join(_marker_sql("line", m) for m in scorer.markers) + ")" if scorer.markers else "false"
    auto = "true" if scorer.auto_detect else "false"
    return f"""{_LN}, st AS (SELECT document, line, count(*) AS repeat_count, min(doc_id) AS first_doc FROM ln GROUP BY ALL),
f AS (SELECT *, strlen(line) AS length, {hit} AS hit, {_any("line", scorer.protected)} AS held, {_any("line", T.URL_HINTS)} AS url,
  CASE WHEN len(regexp_extract_all(line, '\\p{{L}}')) > 0 THEN len(regexp_extract_all(line, '\\p{{Lu}}')) / len(regexp_extract_all(line, '\\p{{L}}')) ELSE 0.0 END AS upper FROM st),
g AS (SELECT *, hit AND NOT held AND length <= 5000 AS marked FROM f),
h AS (SELECT *, {auto} AND NOT marked AND NOT hit AND NOT held AND repeat_count >= 2 AND length <= 2500 AND (url OR upper >= 0.75) AS auto FROM g),
sc AS (SELECT *, CASE WHEN hit THEN 65 ELSE 0 END + CASE WHEN length <= 1800 THEN 18 WHEN length <= 5000 THEN 8 WHEN length > 12000 THEN -30 ELSE 0 END
  + CASE WHEN repeat_count >= 2 THEN 18 ELSE 0 END + CASE WHEN repeat_count >= 4 THEN 10 ELSE 0 END + CASE WHEN url THEN 10 ELSE 0 END
  + CASE WHEN upper >= 0.70 THEN 6 ELSE 0 END - CASE WHEN held THEN 90 ELSE 0 END + CASE WHEN auto THEN 25 ELSE 0 END AS score FROM h),
sf AS (SELECT *, marked OR (auto AND score >= 70) AS safe FROM sc)"""


_EVEN = """CASE WHEN {c} < 1 THEN []::INT[] WHEN {c} <= {m} THEN list_transform(generate_series(0, {c} - 1), lambda i: CAST(i AS INT)) WHEN {m} = 1 THEN [0]
 ELSE list_transform(generate_series(0, {m} - 1), lambda i: CAST(round_even(i * ({c} - 1) / ({m} - 1), 0) AS INT)) END"""
_KEYS = {s["id"]: ["".join(c for c in a.lower() if c.isalnum()) for a in s["aliases"]] for s in REGISTRY}
_FLAGS = f"{_PG}, fl AS (" + " UNION ALL ".join(
    f"SELECT document, doc_id, '{i}' AS id FROM pg WHERE {_any(chr(39).join(['regexp_replace(lower(text), ', '[^a-z0-9]', ', ', '', ', ', 'g', ')']), a)}" for i, a in _KEYS.items()
) + ")"
_CAND = f"""{_FLAGS}, cnt AS (SELECT document, count(*) AS page_count FROM pg GROUP BY 1),
sl AS (SELECT DISTINCT document, doc_id, line FROM (SELECT document, doc_id, unnest(string_split(text, chr(10))) AS line FROM pg) WHERE trim(line) <> ''),
rp AS (SELECT document, line FROM sl GROUP BY ALL HAVING count(*) >= 2),
hp AS (SELECT DISTINCT document, doc_id FROM sl JOIN rp USING (document, line)),
ca AS (SELECT document, id AS marker, count(*) AS n_pages, max(hp.doc_id IS NOT NULL) AS repeated FROM fl LEFT JOIN hp USING (document, doc_id) GROUP BY ALL),
cd AS (SELECT document, marker, n_pages, repeated, least(1.0, 0.45::DOUBLE + 0.35::DOUBLE * n_pages / page_count + CASE WHEN repeated THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END) AS confidence FROM ca JOIN cnt USING (document)),
bs AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY document ORDER BY confidence DESC, marker) = 1)"""
_SYM = "least(1.0, len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(1, length(trim(text))))"
_PROFILE = f"""{_CAND}, ra AS (SELECT document, count(*) AS page_count, avg(CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END) AS tr, avg({_SYM}) AS ir FROM pg GROUP BY 1),
pf AS (SELECT document, page_count, tr, ir, CASE WHEN ir >= 0.8 AND tr <= 0.2 THEN 'raster' WHEN tr >= 0.8 AND ir < 0.15 THEN 'vector' ELSE 'hybrid' END AS kind,
  CASE WHEN ir >= 0.8 AND tr <= 0.2 THEN greatest(ir, 1 - tr) WHEN tr >= 0.8 AND ir < 0.15 THEN greatest(tr, 1 - ir) ELSE 0.8 END AS confidence FROM ra),
pl AS (SELECT pf.document, kind, pf.confidence, ir, bs.marker, bs.repeated, bs.confidence AS sure FROM pf LEFT JOIN bs USING (document)),
rt AS (SELECT *, CASE WHEN kind = 'raster' AND ir >= 0.8 THEN 'raster_template' WHEN sure IS NULL OR sure < 0.70 THEN 'legacy' WHEN sure >= 0.95 AND coalesce(repeated, false) THEN 'stream_remove' ELSE 'vector_remove' END AS strategy,
  CASE WHEN kind = 'raster' AND ir >= 0.8 THEN least(confidence, coalesce(sure, 0.85)) WHEN sure IS NULL OR sure < 0.70 THEN coalesce(sure, least(confidence, 0.69)) ELSE sure END AS plan_confidence FROM pl)"""
_MODEL = f"""{_PX}, md AS (SELECT document, pixel, median(gray) AS med, count(*) AS samples FROM px GROUP BY ALL HAVING count(*) >= 2),
mm AS (SELECT document, pixel, med, samples, median(abs(gray - med)) AS mad FROM px JOIN md USING (document, pixel) GROUP BY ALL),
mb AS (SELECT *, avg(med) OVER (PARTITION BY document) AS background FROM mm),
mo AS (SELECT *, mad <= 8.0 AND med BETWEEN 100 AND 246 AND background - med >= 1.0 AS in_mask FROM mb)"""
_FIXED = f"""{_MODEL}, fx AS (SELECT px.document, page_id, px.pixel, gray, mk.background,
  CASE WHEN mk.background IS NOT NULL AND gray > 105 THEN greatest(gray, least(255, CAST(round_even(greatest(mk.background + 4, gray + 24), 0) AS INT))) ELSE gray END AS fixed
  FROM px LEFT JOIN (SELECT document, pixel, background FROM mo WHERE in_mask) mk ON px.document = mk.document AND px.pixel = mk.pixel)"""
_RESID = f"""{_FIXED}, rs AS (SELECT document, page_id, count(*) FILTER (background IS NOT NULL) AS candidates, count(*) FILTER (background IS NOT NULL AND abs(fixed - gray) >= 3) AS acted,
  sum(greatest(0.0, background - gray)) FILTER (background IS NOT NULL AND abs(fixed - gray) >= 3) AS was, sum(greatest(0.0, background - fixed)) FILTER (background IS NOT NULL AND abs(fixed - gray) >= 3) AS rest FROM fx GROUP BY ALL),
rr AS (SELECT document, page_id, candidates, acted, CASE WHEN acted = 0 THEN CASE WHEN candidates > 0 THEN 1.0 ELSE 0.0 END WHEN was = 0 THEN 0.0 ELSE least(1.0, rest / was) END AS residual FROM rs)"""


# ---- sampling ------------------------------------------------------------------------------------------------------
@query(f"""WITH c AS (SELECT source AS document, count(*) AS n FROM documents GROUP BY 1),
a AS (SELECT document, n, {_EVEN.format(c="n", m=8)} AS s8 FROM c), b AS (SELECT *, list_transform({_EVEN.format(c="len(s8)", m=5)}, lambda i: s8[i + 1]) AS s5 FROM a),
d AS (SELECT *, list_transform({_EVEN.format(c="len(s5)", m=3)}, lambda i: s5[i + 1]) AS s3 FROM b)
SELECT document, n AS page_count, array_to_string(s3, ',') AS stage_3, array_to_string(s5, ',') AS stage_5, array_to_string(s8, ',') AS stage_8 FROM d""")
def staged_sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pages(spark, sf_dir).groupBy("document").agg(F.count("*").alias("page_count"))
    three, five, eight = sampling.staged(F.col("page_count").cast("int"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return counts.select("document", "page_count", joined(three).alias("stage_3"), joined(five).alias("stage_5"), joined(eight).alias("stage_8"))


@query(f"""WITH c AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, count(*) AS n FROM pages GROUP BY 1)
SELECT document, n AS page_count, array_to_string(list_sort(list_distinct({_EVEN.format(c="n", m=12)})), ',') AS sample FROM c""")
def qc_quick_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.table(spark, sf_dir, "pages").groupBy(tables.host("url").alias("document")).agg(F.count("*").alias("page_count"))
    sample = F.array_sort(F.array_distinct(sampling.even(F.col("page_count").cast("int"), 12)))
    return counts.select("document", "page_count", F.array_join(F.transform(sample, lambda x: x.cast("string")), ",").alias("sample"))


# ---- analysis ------------------------------------------------------------------------------------------------------
@query(f"""SELECT source AS document, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_index, doc_id,
CASE WHEN length(trim(text)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS text_coverage, round({_SYM}, 6) AS image_coverage, CAST(length(trim(text)) AS INT) AS text_char_count FROM documents""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    rows = analysis.page_evidence(pages).join(tables.numbered(pages), ["document", "doc_id"])
    return rows.select("document", "page_index", "doc_id", "text_coverage", F.round("image_coverage", 6).alias("image_coverage"), "text_char_count")


@query(f"WITH {_PROFILE} SELECT document, page_count, kind, round(confidence, 6) AS confidence, round(tr, 6) AS text_layer_ratio, round(ir, 6) AS full_page_image_ratio FROM pf")
def classify_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.ratios(analysis.page_evidence(_pages(spark, sf_dir)))
    kind, sure = analysis.classify(F.col("text_layer_ratio"), F.col("full_page_image_ratio"))
    return rows.select(
        "document", "page_count", kind.alias("kind"), F.round(sure, 6).alias("confidence"), F.round("text_layer_ratio", 6).alias("text_layer_ratio"),
        F.round("full_page_image_ratio", 6).alias("full_page_image_ratio"),
    )


@query(f"""WITH {_PG}, sl AS (SELECT DISTINCT document, doc_id, line FROM (SELECT document, doc_id, unnest(string_split(text, chr(10))) AS line FROM pg) WHERE trim(line) <> '')
SELECT document, sha256(line) AS sha256, count(*) AS n_pages FROM sl GROUP BY ALL HAVING count(*) >= 2""")
def repeated_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.repeated_on_pages(_pages(spark, sf_dir))


@query(f"WITH {_LN} SELECT document, sha1(line) AS sha1, count(*) AS n_references FROM ln GROUP BY ALL HAVING count(*) >= 2")
def reference_count_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.reference_counts(_lines(spark, sf_dir)).where("n_references >= 2")


@query(f"WITH {_FLAGS} SELECT document, id, doc_id FROM fl")
def signature_page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each signature, a row each: a document may have any number of them."""
    return analysis.signature_flags(_pages(spark, sf_dir), REGISTRY).select("document", "id", "doc_id")


@query(f"WITH {_FLAGS} SELECT document, id, count(*) AS n_pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM fl GROUP BY ALL")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = analysis.signature_flags(_pages(spark, sf_dir), REGISTRY)
    return flags.groupBy("document", "id").agg(F.count("*").alias("n_pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))


@query("SELECT b.item_id, count(*) AS n_documents, min(d.doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text.  A candidate must hold the text's first long word, so the join has a key;
    the containment test then runs on the few candidates.  Texts of one or two words have no such word and are tested on
    every document."""
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    # Inner words of a contained text are whole words of the document; the longest is rare.
    inner = lambda c: F.slice(F.split(c, " "), 2, F.greatest(F.lit(0), F.size(F.split(c, " ")) - 2))
    longest = F.array_max(F.transform(inner("needle"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = items.withColumn("key", longest)
    wordless = docs.join(F.broadcast(keyed.where("key is null")), F.col("text").contains(F.col("needle")))
    keyed = keyed.where("key is not null")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    pairs = words.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    hits = pairs.join(docs, "doc_id").join(items, "item_id").where(F.col("text").contains(F.col("needle")))
    hits = hits.select("item_id", "doc_id").unionByName(wordless.select("item_id", "doc_id"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {_CAND} SELECT document, marker, n_pages, repeated, round(confidence, 6) AS confidence FROM cd")
def candidate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.candidates(_pages(spark, sf_dir), REGISTRY).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_CAND} SELECT document, marker, repeated, round(confidence, 6) AS candidate_confidence FROM bs")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.best_candidate(analysis.candidates(_pages(spark, sf_dir), REGISTRY)).withColumn("candidate_confidence", F.round("candidate_confidence", 6))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    rows = analysis.ratios(analysis.page_evidence(pages))
    kind, sure = analysis.classify(F.col("text_layer_ratio"), F.col("full_page_image_ratio"))
    profiles = rows.withColumns({"kind": kind, "confidence": sure})
    return routing.plan(profiles.join(routing.best_candidate(analysis.candidates(pages, REGISTRY)), "document", "left"))


@query(f"""WITH {_PROFILE} SELECT document, kind, strategy, round(plan_confidence, 6) AS plan_confidence, marker,
CASE WHEN strategy = 'raster_template' THEN plan_confidence < 0.95 ELSE strategy = 'vector_remove' END AS requires_strict_qc FROM rt""")
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("document", "kind", "strategy", F.round("plan_confidence", 6).alias("plan_confidence"), "marker", "requires_strict_qc")


@query(f"WITH {_PROFILE} SELECT document, 'stream_clean' AS requested_engine, strategy, strategy <> 'stream_remove' AS rejected FROM rt")
def preference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.apply_preference(_plans(spark, sf_dir), "stream_clean").select("document", "requested_engine", "strategy", "rejected")


@query("""WITH d AS (SELECT doc_id, 'size:' || strlen(text) || ':' AS head, encode(text) AS raw FROM documents)
SELECT doc_id, sha256(encode(head) || CASE WHEN octet_length(raw) <= 131072 THEN raw ELSE raw[1:65536] || raw[-65536:] END) AS fingerprint FROM d""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", analysis.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT user_id, max(event_id) AS last_access, count(*) AS hits FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
def profile_cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.lru(tables.table(spark, sf_dir, "events"), "user_id", "event_id", 32)


@query(f"""WITH f AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, page_id, unnest(list_distinct(regexp_extract_all(html, '{tables.FRAGMENT}', 1))) AS fragment FROM pages)
SELECT document, sha256(fragment) AS sha256, count(*) AS n_pages FROM f GROUP BY ALL HAVING count(*) >= 2""")
def html_overlay_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.fragments(tables.table(spark, sf_dir, "pages")).distinct()
    return rows.groupBy("document", F.sha2("fragment", 256).alias("sha256")).agg(F.count("*").alias("n_pages")).where("n_pages >= 2")


@query("""SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, count(*) AS n_pages, CAST(sum(len(regexp_extract_all(html, 'href="'))) AS BIGINT) AS n_links,
CAST(sum(CASE WHEN contains(lower(url), 'example.com') THEN 1 ELSE 0 END) AS BIGINT) AS n_known FROM pages GROUP BY 1""")
def metadata_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").groupBy(tables.host("url").alias("document")).agg(
        F.count("*").alias("n_pages"), F.sum(F.regexp_count("html", F.lit('href="'))).alias("n_links"), F.count_if(F.lower("url").contains("example.com")).alias("n_known")
    )


# ---- streams -------------------------------------------------------------------------------------------------------
@query(f"WITH {_scored_sql(SCORER)} SELECT document, sha1(line) AS sha1, repeat_count, length, score, safe FROM sf")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.distinct_streams(_lines(spark, sf_dir), SCORER)
    return rows.select("document", "sha1", "repeat_count", F.col("length").cast("long").alias("length"), "score", "safe")


@query(f"WITH {_scored_sql(SCORER)} SELECT document, sha1(line) AS sha1, repeat_count, first_doc, score FROM sf WHERE safe")
def stream_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.distinct_streams(_lines(spark, sf_dir), SCORER).where("safe")
    return rows.select("document", "sha1", "repeat_count", "first_doc", "score")


@query(f"WITH {_scored_sql(AUTO)} SELECT document, sha1(line) AS sha1, repeat_count, length, score, safe FROM sf WHERE auto")
def auto_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.distinct_streams(_lines(spark, sf_dir), AUTO).where("auto")
    return rows.select("document", "sha1", "repeat_count", F.col("length").cast("long").alias("length"), "score", "safe")


@query(f"""WITH {_scored_sql(SCORER)}, nb AS (SELECT document, doc_id, CAST(row_number() OVER (PARTITION BY document ORDER BY doc_id) AS VARCHAR) AS page FROM pg),
cs AS (SELECT document, page, sha1(line) AS sha1, score, safe FROM sf JOIN nb ON sf.document = nb.document AND sf.first_doc = nb.doc_id WHERE safe OR score >= 35)
SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY NOT safe, -score, page, sha1) AS INT) AS place, page, sha1, score, safe FROM cs""".replace("SELECT document, page, sha1(line)", "SELECT sf.document, page, sha1(line)"))
def candidate_rows_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in display order.  Pages compare as text, so page 10 comes before page 2."""
    rows = streams.candidates(_lines(spark, sf_dir), SCORER)
    numbers = tables.numbered(_pages(spark, sf_dir)).select("document", F.col("doc_id").alias("first_doc"), (F.col("page_index") + 1).cast("string").alias("page"))
    return streams.in_order(rows.join(numbers, ["document", "first_doc"])).select("document", "place", "page", "sha1", "score", "safe")


@query(f"""WITH {_scored_sql(SCORER)}, sl AS (SELECT document, list(line) AS ls FROM sf WHERE safe GROUP BY 1),
nt AS (SELECT pg.document, doc_id, text, CASE WHEN ls IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ls, x)) END AS kept FROM pg LEFT JOIN sl ON pg.document = sl.document)
SELECT document, doc_id, sha256(array_to_string(kept, chr(10))) AS text_sha256, CAST(len(string_split(text, chr(10))) - len(kept) AS INT) AS n_removed FROM nt""")
def remove_safe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = streams.remove_safe(_pages(spark, sf_dir), _lines(spark, sf_dir), SCORER)
    return cleaned.select("document", "doc_id", F.sha2("text", 256).alias("text_sha256"), "n_removed")


@query(f"""WITH {_scored_sql(SCORER)} SELECT document, count(*) FILTER (safe) AS removed_streams, count(DISTINCT first_doc) FILTER (safe) AS changed_pages,
count(*) FILTER (NOT safe AND score >= 35) AS skipped_streams FROM sf GROUP BY 1""")
def removal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.removal_summary(_lines(spark, sf_dir), SCORER)


_PRESERVED = [k for k in ("".join(c for c in m.lower() if c.isalnum()) for m in MARKERS)]
_MARKED = "(" + " OR ".join(f"contains(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{k}')" for k in _PRESERVED) + ")"


@query(f"""WITH {_PG} SELECT document, doc_id, CAST(length(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {_MARKED}), chr(10)))) AS INT) AS kept_chars,
CAST(coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: {_MARKED}), lambda x: length(x))), 0) AS INT) AS removed_chars FROM pg""")
def text_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.preserved(_pages(spark, sf_dir), MARKERS)


@query(f"""WITH {_PG} SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') = '' AS blank,
round(CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) > 0 THEN len(regexp_extract_all(text, '\\p{{Lu}}')) / len(regexp_extract_all(text, '\\p{{L}}')) ELSE 0.0 END, 6) AS upper_ratio,
{_any("text", T.URL_HINTS)} AS has_url, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS n_ascii FROM pg""")
def text_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _pages(spark, sf_dir).select(
        "doc_id", (T.fold_simple(text) == "").alias("blank"), F.round(T.upper_ratio(text), 6).alias("upper_ratio"), T.any_of(text, T.URL_HINTS).alias("has_url"),
        F.length(T.ascii_only(text)).cast("long").alias("n_ascii"),
    )


@query("SELECT doc_id, sha256(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')) AS fold_sha256 FROM documents")
def exact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold needs Unicode normalisation; an Arrow UDF on the texts that have more than ASCII."""
    return _pages(spark, sf_dir).select("doc_id", F.sha2(T.exact_fold(F.col("text")), 256).alias("fold_sha256"))


@query("""SELECT page_id, CASE WHEN lower(c) LIKE '%.pdf' THEN c ELSE c || '.pdf' END AS file_name FROM
(SELECT page_id, regexp_replace(trim(url), '[^0-9A-Za-zÀ-ɏḀ-ỿ ._-]+', '_', 'g') AS c FROM pages)""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("file_name"))


# ---- rasters -------------------------------------------------------------------------------------------------------
#: Thresholds that select something on the 8x8 stand-in rasters.
RASTER = {"most_mad": 8.0, "low": 100, "high": 246, "least_contrast": 1.0}


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.consensus(_pixels(spark, sf_dir), **RASTER)


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    return rasters.repaired(pixels, rasters.consensus(pixels, **RASTER))


@query(f"WITH {_MODEL} SELECT document, pixel, samples, round(med, 3) AS med, round(mad, 3) AS mad, round(background, 6) AS background, in_mask FROM mo")
def raster_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).select(
        "document", F.col("pixel").cast("long").alias("pixel"), "samples", F.round("med", 3).alias("med"), F.round("mad", 3).alias("mad"), F.round("background", 6).alias("background"), "in_mask"
    )


@query(f"""WITH {_MODEL}, a AS (SELECT document, avg(CASE WHEN in_mask THEN 1 ELSE 0 END) AS support, avg(CASE WHEN in_mask THEN mad END) AS noise FROM mo GROUP BY 1)
SELECT document, round(support, 6) AS support, CASE WHEN support = 0 THEN 0.0
ELSE round(greatest(0.0, least(0.98, 0.55 + 0.30 * greatest(0.0, least(1.0, 1 - noise / 12)) + 0.15 * least(1.0, support / 0.02))), 6) END AS confidence FROM a""")
def consensus_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.consensus_confidence(_model(spark, sf_dir))
    return rows.select("document", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_RESID} SELECT document, page_id, candidates, acted, round(residual, 6) AS residual FROM rr")
def residual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.residual(_fixed(spark, sf_dir)).withColumn("residual", F.round("residual", 6))


@query(f"""WITH {_RESID}, ch AS (SELECT document, page_id, count(*) AS n, count(*) FILTER (fixed <> gray) AS changed FROM fx GROUP BY ALL)
SELECT document, count(*) AS n_pages, round(max(residual), 6) AS residual, round(sum(changed) / greatest(1, sum(n)), 6) AS changed_ratio FROM ch JOIN rr USING (document, page_id) GROUP BY 1""")
def guided_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.guided_rollup(_fixed(spark, sf_dir))
    return rows.select("document", "n_pages", F.round("residual", 6).alias("residual"), F.round("changed_ratio", 6).alias("changed_ratio"))


_OUT = f"""{_FIXED}, op AS (SELECT document, page_id, count(*) FILTER (NOT (pixel >= 56) AND abs(gray - fixed) >= 24) AS changed, count(*) FILTER (NOT (pixel >= 56)) AS n FROM fx GROUP BY ALL),
oc AS (SELECT document, count(*) AS n_pages, sum(changed) / greatest(1, sum(n)) AS ratio, count(*) FILTER (changed / greatest(1, n) > 0.08) AS n_failed_pages FROM op GROUP BY 1)"""


@query(f"WITH {_OUT} SELECT document, n_pages, round(ratio, 6) AS outside_change_ratio, n_failed_pages FROM oc")
def outside_change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.outside_change(_fixed(spark, sf_dir), allowed="pixel >= 56").withColumn("outside_change_ratio", F.round("outside_change_ratio", 6))


@query(f"""WITH {_OUT.replace(_FIXED, _RESID, 1)}, wr AS (SELECT document, max(residual) AS residual FROM rr GROUP BY 1),
v AS (SELECT document, array_to_string(list_filter([CASE WHEN residual > 0.08 THEN 'residual' END, CASE WHEN ratio > 0.08 THEN 'outside_change' END], lambda x: x IS NOT NULL), ',') AS reasons FROM oc JOIN wr USING (document))
SELECT document, reasons = '' AS ok, reasons FROM v""")
def qc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _fixed(spark, sf_dir)
    worst = rasters.residual(fixed).groupBy("document").agg(F.max("residual").alias("residual"))
    absent = F.lit(None).cast("double")
    metrics = qc.outside_change(fixed, allowed="pixel >= 56").join(worst, "document").withColumns(
        {"page_count_ok": F.lit(True), "geometry_ok": F.lit(True), "footer_residual": absent, "protected_change": absent}
    )
    return qc.verdict(metrics).select("document", "ok", "reasons")


_REPORT = f"""WITH {_scored_sql(SCORER)}, sl AS (SELECT document, list(line) AS ls FROM sf WHERE safe GROUP BY 1),
nt AS (SELECT pg.document, doc_id, length(text) AS b, length(array_to_string(CASE WHEN ls IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ls, x)) END, chr(10))) AS a FROM pg LEFT JOIN sl ON pg.document = sl.document),
rp AS (SELECT *, CASE WHEN a / greatest(1, b) < 0.98 THEN 'warned' ELSE 'passed' END AS status FROM nt)"""


@query(f"""{_REPORT} SELECT document, doc_id, status, round(a / greatest(1, b), 6) AS kept_ratio FROM rp WHERE status <> 'passed'""")
def qc_flagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the summary counts."""
    pages = _pages(spark, sf_dir)
    rows = qc.page_report(pages, streams.remove_safe(pages, _lines(spark, sf_dir), SCORER)).where("status <> 'passed'")
    return rows.select("document", "doc_id", "status", F.round("kept_ratio", 6).alias("kept_ratio"))


@query(f"""{_REPORT} SELECT document, count(*) AS n_pages, 0::BIGINT AS n_failed, count(*) FILTER (status = 'warned') AS n_warned, true AS ok FROM rp GROUP BY 1""")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return qc.summary(qc.page_report(pages, streams.remove_safe(pages, _lines(spark, sf_dir), SCORER)))


@query(f"""WITH {_PX}, hg AS (SELECT document, gray, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
cu AS (SELECT document, gray, sum(n) OVER a AS w0, sum(n) OVER b AS w, sum(n * gray) OVER a AS s0, sum(n * gray) OVER b AS s FROM hg WINDOW a AS (PARTITION BY document ORDER BY gray), b AS (PARTITION BY document))
SELECT document, gray AS threshold FROM cu WHERE w0 < w QUALIFY row_number() OVER (PARTITION BY document ORDER BY round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 3) DESC, gray) = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.otsu(_pixels(spark, sf_dir))


_ROWS = f"{_PX}, rm AS (SELECT document, page_id, CAST(floor(pixel / 8) AS INT) AS y, avg(gray) AS mean FROM px GROUP BY ALL)"
_SMOOTH = f"{_ROWS}, sm AS (SELECT a.document, a.page_id, a.y, a.mean, median(b.mean) AS smooth FROM rm a, unnest([-1, 0, 1]) AS t(o) JOIN rm b ON b.document = a.document AND b.page_id = a.page_id AND b.y = greatest(0, least(7, a.y + o)) GROUP BY ALL)"


@query(f"WITH {_SMOOTH} SELECT document, page_id, y, round(mean, 6) AS mean, round(smooth, 6) AS smooth FROM sm")
def moving_median_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.moving_median(rasters.row_means(_pixels(spark, sf_dir)), "mean")
    return rows.select("document", "page_id", "y", F.round("mean", 6).alias("mean"), F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {_SMOOTH}, sc AS (SELECT document, y, round(avg(smooth - mean), 6) AS score FROM sm GROUP BY ALL), hi AS (SELECT document, y FROM sc WHERE score >= 0.5),
gp AS (SELECT *, y - lag(y) OVER (PARTITION BY document ORDER BY y) AS gap FROM hi) SELECT document, count(*) AS n_lines, median(gap)::DOUBLE AS spacing, max(y) - min(y) AS spread FROM gp GROUP BY 1""")
def ruled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.moving_median(rasters.row_means(_pixels(spark, sf_dir)), "mean")
    return rasters.ruled_rows(rows, least=0.5)


@query(f"""WITH {_PX}, t AS (SELECT *, pixel % 8 AS x, floor(pixel / 8) AS y FROM px), u AS (SELECT *, greatest(0.0, least(1.0, (x * 7 + y * 7) / 98.0)) AS t FROM t)
SELECT document, page_id, count(*) FILTER (sqrt(pow(x - t * 7, 2) + pow(y - t * 7, 2)) <= 1.2) AS n_band, round(avg(gray) FILTER (sqrt(pow(x - t * 7, 2) + pow(y - t * 7, 2)) <= 1.2), 6) AS band_gray FROM u GROUP BY ALL""")
def diagonal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.band(_pixels(spark, sf_dir), 0, 0, 7, 7, 1.2)
    return rows.groupBy("document", "page_id").agg(F.count_if("in_band").alias("n_band"), F.round(F.avg(F.when(F.col("in_band"), F.col("gray"))), 6).alias("band_gray"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(F.col("label").alias("document"), F.col("vec_id").alias("page_id"), "embedding")


def _kernel_query(spark: SparkSession, sf_dir: str, fields: str, measure) -> DataFrame:
    """Run ``measure`` on the 8x8 gray raster of every page."""
    import numpy as np
    import pandas as pd

    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for e in batch["embedding"]:
                page = np.clip(np.rint((np.asarray(e, float) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(8, 8)
                out.append(measure(page))
            yield pd.concat([batch[["document", "page_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    # Kernels cost far more than moving a page, so pages are dealt evenly, however few files they come from.
    return _masks(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "page_id").mapInPandas(run, f"document int, page_id long, {fields}")


def _large(page):
    """An 8x8 raster as an RGB page of 96x96 pixels."""
    import numpy as np

    return np.repeat(np.kron(page, np.ones((12, 12), np.uint8))[..., None], 3, 2)


@query()
def ruled_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(page):
        out, meta = ruledpages.clean(_large(page))
        return bool(meta["ruled"]), meta["centers"], meta["confidence"], meta["diagonal"], int(out.astype(int).sum())

    return _kernel_query(spark, sf_dir, "ruled boolean, centers int, confidence double, diagonal int, total long", measure)


@query()
def ink_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(page):
        _, meta = inkpages.clean(_large(page))
        return meta["removed"], meta["protected"], meta["graph"]

    return _kernel_query(spark, sf_dir, "removed int, protected int, graph boolean", measure)


@query()
def hybrid_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(page):
        got = inkpages.page_result(_large(page), lambda p: inkpages.clean(p)[0])
        return got["mode"], len(got["patches"]), round(got["changed"], 6), got["fallback"]

    return _kernel_query(spark, sf_dir, "mode string, n_patches int, changed double, used_fallback boolean", measure)


@query()
def guided_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(page):
        before = _large(page)
        out, meta = guided.clean_native(before, (96.0, 96.0), dpi=48)
        metrics = guided.page_metrics(before, out)
        return meta["level"], round(meta["residual"], 6), round(meta["changed"], 6), metrics["ok"], round(metrics["dark_loss"], 6)

    return _kernel_query(spark, sf_dir, "level string, residual double, changed double, ok boolean, dark_loss double", measure)


@query(f"""WITH {_FIXED}, c AS (SELECT document, page_id, count(*) FILTER (fixed <> gray) / count(*) AS changed, count(DISTINCT CAST(floor(pixel / 8) AS INT)) FILTER (fixed <> gray) AS patches FROM fx GROUP BY ALL)
SELECT document, page_id, round(changed, 6) AS changed, patches, CASE WHEN changed > 0.42 OR patches / 8 > 0.62 OR patches > 120 THEN 'full_raster' ELSE 'hybrid' END AS mode FROM c""")
def hybrid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rows of a raster stand in for patches."""
    moved = F.col("fixed") != F.col("gray")
    rows = _fixed(spark, sf_dir).groupBy("document", "page_id").agg(
        (F.count_if(moved) / F.count("*")).alias("changed"), F.count_distinct(F.when(moved, F.floor(F.col("pixel") / 8))).alias("patches")
    )
    return rows.select("document", "page_id", F.round("changed", 6).alias("changed"), "patches", rasters.hybrid_choice(F.col("changed"), F.col("patches") / 8, F.col("patches"), F.lit(False)).alias("mode"))


@query("""WITH r AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
SELECT document, count(*) AS n_pages, count(*) FILTER (len(list_filter(links, lambda u: NOT contains(lower(u), '/the'))) > 0) AS n_foreign FROM r GROUP BY 1""")
def link_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "pages").select(tables.host("url").alias("document"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("links"))
    foreign = F.exists("links", lambda u: ~guided.known_link(u, ("/the",)))
    return rows.groupBy("document").agg(F.count("*").alias("n_pages"), F.count_if(foreign).alias("n_foreign"))


@query("""WITH p AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS document, page_id, strlen(html) AS page_area, unnest(regexp_extract_all(html, '(?s)<article>.*?</article>')) AS f FROM pages)
SELECT document, page_id, round(max(least(1.0, strlen(f) / page_area)), 6) AS coverage FROM p GROUP BY ALL""")
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles stand in for images, bytes for areas."""
    rows = tables.table(spark, sf_dir, "pages").select(
        tables.host("url").alias("document"), "page_id", F.octet_length("html").cast("double").alias("page_area"), F.explode(F.regexp_extract_all("html", F.lit("(?s)<article>.*?</article>"), F.lit(0))).alias("f")
    )
    return guided.coverage(rows.withColumn("area", F.octet_length("f").cast("double"))).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT rule, n_rows FROM (SELECT 'positive_chars' AS rule, count(*) FILTER (NOT n_chars > 100) AS n_rows FROM documents UNION ALL
SELECT 'known_language', count(*) FILTER (NOT lang IN ('en', 'de')) FROM documents UNION ALL SELECT 'has_id', count(*) FILTER (NOT doc_id >= 0) FROM documents) WHERE n_rows > 0""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"positive_chars": "n_chars > 100", "known_language": "lang IN ('en', 'de')", "has_id": "doc_id >= 0"}
    return guided.violations(tables.table(spark, sf_dir, "documents"), rules)


@query(f"""WITH {_PROFILE.replace(_FLAGS, _scored_sql(SCORER) + ", " + _FLAGS.replace(_PG + ", ", ""), 1)}, sl2 AS (SELECT document, list(line) AS ls FROM sf WHERE safe GROUP BY 1)
SELECT pg.document, doc_id, rt.strategy <> 'stream_remove' AS used_fallback, sha256(CASE WHEN rt.strategy = 'stream_remove' AND ls IS NOT NULL
 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ls, x)), chr(10)) ELSE text END) AS text_sha256
FROM pg JOIN rt ON pg.document = rt.document LEFT JOIN sl2 ON pg.document = sl2.document""")
def document_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job up to publishing: analysis, plan, execution."""
    pages, lines = _pages(spark, sf_dir), _lines(spark, sf_dir)
    result = process.execute(pages, lines, process.plan(process.analyze(pages, REGISTRY)), REGISTRY)
    return result.select("document", "doc_id", "used_fallback", F.sha2("text", 256).alias("text_sha256"))


# ---- jobs ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {_LOG} SELECT job_id, count(*) AS n_events, max(event_id) AS last_event, arg_max(stage, event_id) IN ('done', 'failed', 'cancelled') AS terminal FROM log WHERE event_id > 500 GROUP BY 1""")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.after(_log(spark, sf_dir), 500)


@query(f"WITH {_LOG}, k AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) <= 20) SELECT job_id, event_id, stage, percent FROM k")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retained(_log(spark, sf_dir), 20).select("job_id", "event_id", "stage", "percent")


@query(f"WITH {_LOG} SELECT job_id, arg_max(stage, event_id) AS stage, arg_max(percent, event_id) AS percent, max(event_id) AS last_event FROM log GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_log(spark, sf_dir))


@query(ORACLE_SQL["latest_state"])
def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state again, from the log read as a stream; the pattern lets the table be one file or a folder of files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return events.run_into(events.latest_state(events.log_stream(spark, f"{sf_dir}/events.parque[t]")), f"{base}/states", f"{base}/checkpoint")


@query(f"""WITH {_LOG}, s AS (SELECT job_id, arg_max(stage, event_id) AS stage, max(event_id) AS last_event FROM log GROUP BY 1)
SELECT job_id, stage, last_event FROM s ORDER BY stage IN ('done', 'failed', 'cancelled'), last_event DESC LIMIT 20""")
def prune_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pruned(jobs.latest(_log(spark, sf_dir)), 20).select("job_id", "stage", "last_event")


@query("SELECT lower(regexp_extract(url, 'https?://([^/]+)', 1)) AS key, min(page_id) AS first FROM pages GROUP BY 1")
def input_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_inputs(tables.table(spark, sf_dir, "pages"), F.lower(tables.host("url")), "page_id")


@query("SELECT event_type, count(*) AS n_runs, median(value) AS value_median FROM events GROUP BY 1")
def benchmark_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.benchmark_medians(tables.table(spark, sf_dir, "events"), "event_type", ["value"])


@query("""WITH c AS (SELECT conv_id, count(*) AS n_parts, string_agg(text, chr(10) ORDER BY turn) AS joined, min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM conversations GROUP BY 1)
SELECT conv_id, CAST(n_parts AS INT) AS n_parts, sha256(joined) AS joined_sha256, complete FROM c""")
def page_order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.ordered_parts(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "n_parts", F.sha2("joined", 256).alias("joined_sha256"), "complete")


from . import page_kernels, rules  # noqa: E402, F401  they register their queries here
