"""One place that builds a SparkSession with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps equal on every machine; AQE re-plans joins at run time; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "folioforge", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; ``settings`` use ``__`` for dots and win over them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local session, whose executors are this machine, may do
    without; it uses a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")
