"""Every query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from folioforge.plans import catalogue


def _norm(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, expected = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _norm(got) == _norm(expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_short_benchmark_items(spark, tmp_path):
    texts = {"documents": ("doc_id", ["one two three four", "two three", "stone two", "", None]), "benchmark": ("item_id", ["one", "two three", "one two three", "absent", None])}
    con = duckdb.connect()
    for name, (key, rows) in texts.items():
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalogue.QUERIES["benchmark_passages"](spark, str(tmp_path)).toPandas()
    assert len(got) == 3 and _norm(got) == _norm(con.sql(catalogue.ORACLE_SQL["benchmark_passages"]).df())


def test_native_image_on_the_limit(spark, tmp_path):
    def html(article, area):
        return "<article>" + "x" * (article - 19) + "</article>" + "y" * (area - article)

    pages = [(i, "https://a.org/x", html(*sizes)) for i, sizes in enumerate([(1425, 2100), (1424, 2100), (2193, 3200), (1500, 2100), (57, 84)])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["native_image_choice"](spark, str(tmp_path)).collect()))
    assert [r[1] for r in got] == [0, 2, 3, 4] and got == sorted(con.execute(catalogue.ORACLE_SQL["native_image_choice"]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
