"""Files: discovery, signature registry, reports, and publishing with a staging directory."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of matching files; contents are read only if used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)


def load_signatures(path: str | None = None) -> list[dict]:
    """The registry: id, aliases, typical_regions, repetition_expected of each signature, sorted by id."""
    text = (Path(path) if path else Path(__file__).parent.parent / "data/signatures.json").read_text(encoding="utf-8")
    found = json.loads(text)
    for s in found:
        if not s.get("id") or not s.get("aliases"):
            raise ValueError("a signature needs an id and aliases")
    return sorted(found, key=lambda s: s["id"])


def signatures_frame(spark: SparkSession, found: list[dict]) -> DataFrame:
    """id, alias rows of a registry."""
    return spark.createDataFrame([(s["id"], a) for s in found for a in s["aliases"]], "id string, alias string")


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def unique_name(name: str, taken: set[str], most: int = 9999) -> str:
    """``name``, else ``name_2``, ``name_3``, ..."""
    if name not in taken:
        return name
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot else (name, "")
    for i in range(2, most + 1):
        if (candidate := f"{stem}_{i}{suffix}") not in taken:
            return candidate
    raise FileExistsError(name)


class Publisher:
    """Writes to a staging directory; only accepted results replace what is published, the old version is kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self._conf)

    def stage(self, frame: DataFrame) -> str:
        name = f"_staging/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.folder}/{name}")
        return name

    def promote(self, staged: str, name: str) -> str | None:
        """Put a staged table in place; returns the name of the backup of the table that was there."""
        source, fs = self._path(staged)
        target, _ = self._path(name)
        backup = None
        if fs.exists(target):
            i = 1
            while fs.exists(self._path(backup := f"{name}_backup" + (f"_{i}" if i > 1 else ""))[0]):
                i += 1
            if not fs.rename(target, self._path(backup)[0]):
                raise OSError(f"cannot move {name} away")
        if not fs.rename(source, target):
            raise OSError(f"cannot publish {name}")
        return backup

    def reject(self, staged: str) -> None:
        path, fs = self._path(staged)
        fs.delete(path, True)


def preflight(pages: DataFrame) -> DataFrame:
    """Pages, characters and links of each document."""
    return pages.groupBy("document").agg(
        F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.regexp_count("text", F.lit("https?://"))).alias("n_links")
    )
