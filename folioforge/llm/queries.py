"""Queries of the training-data operators over the ``documents`` and ``labels`` tables, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, linerules, mixing, orderminhash, packing, quality, sharding, simhash, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=1024, end_token=2)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.clean(_table(spark, sf_dir, "documents"), texts=False)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(_table(spark, sf_dir, "documents"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 8).withColumnRenamed("id", "doc_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orderminhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_texts", "keep")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


# ---- parts of the results above that SQL can state
def line_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that ``op2_line_rules`` takes of every text."""
    return op2_line_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_LINE_BASE_COUNTS = """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, range(1, len(words) - 1) r(i)), rp AS (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) > 1),
cv AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t JOIN rp USING (doc_id, g), range(3) r(k) GROUP BY 1),
c AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cv.n, 0) AS n_repeat_words FROM w LEFT JOIN cv ON cv.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets to which ``op4_mix`` brings the sources."""
    found = mixing.source_targets(_table(spark, sf_dir, "documents"), mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES)
    return found.select("source", F.col("source_size").cast("long").alias("source_size"), F.round("target", 3).alias("target"))


_MIX_TARGETS = """WITH z AS (SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS size FROM documents GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM z),
l AS (SELECT *, 2 * size / weight AS stop, (1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w
 WINDOW before AS (ORDER BY 2 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min(stop) AS stop, arg_min(level, stop) AS level FROM l WHERE level <= stop)
SELECT source, size AS source_size, round(CASE WHEN (SELECT level FROM c) IS NULL THEN 2 * size ELSE least(2 * size, weight * (SELECT level FROM c)) END, 3)::DOUBLE AS target FROM l"""


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fingerprints within seven bits of those of every hundredth id."""
    return simhash.neighbours(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_pack, op2_line_rules, op3_suffix, op4_mix, op5_toxicity, op6_quality, op7_simhash, op8_shard,
            op9_near_duplicates, op10_licences, line_base_counts, mix_targets, simhash_neighbours,
        )
    }


def oracle_sql() -> dict[str, str]:
    """None of the contracts can be stated in SQL as a whole; tests hold those queries against brute force."""
    return {"line_base_counts": _LINE_BASE_COUNTS, "mix_targets": _MIX_TARGETS}
