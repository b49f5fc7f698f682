"""REST reads in ranges of pages and database reads in even splits."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from sluiceway.sources import jdbc_splits, readers, rest

from .conftest import DATA, rows


@pytest.fixture(scope="module")
def service(spark):
    """A service over a table: pages or offsets, at most 50 records a request, with and without a total, failing now and then."""
    table = sorted((json.loads(r) for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_totalprice").toJSON().collect()), key=lambda r: r["o_orderkey"])
    asked: list[dict] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            if "shaky" in self.path and len(asked) % 5 == 0:
                self.send_response(503)
                self.end_headers()
                return
            size = min(50, int(q.get("page_size") or q.get("limit")))
            at = (int(q["page"]) - 1) * size if "page" in q else int(q["offset"])
            body = {"data": table[at : at + size]} | ({"meta": {"total": len(table)}} if "total" in self.path else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", table, asked
    server.shutdown()


@pytest.mark.parametrize("style", ["page", "offset"])
@pytest.mark.parametrize("path", ["/total", "/plain", "/shaky"])
def test_ranges_hold_every_record_once(spark, service, style, path):
    url, table, asked = service
    asked.clear()
    config = {"url": url + path, "pagination": style, "page_size": 1000, "total_key": "meta.total", "num_partitions": 5, "retry_delay": 0.01, "schema": "o_orderkey bigint, o_totalprice double"}
    got = readers.read_source(spark, "rest", config)
    assert got.rdd.getNumPartitions() == 5
    asked.clear()
    assert sorted(r["o_orderkey"] for r in got.collect()) == [r["o_orderkey"] for r in table]
    pages = len(table) // 50
    assert len(asked) < 2 * pages + 40


def test_last_page_by_halving():
    for last in (0, 1, 2, 6, 7, 8, 100, 1023):
        tried = []
        assert rest.last_page(lambda n, last=last, tried=tried: tried.append(n) or n <= last, 10_000) == last
        assert len(tried) <= 22
    assert rest.last_page(lambda n: True, 37) == 37


def test_ranges_that_come_short_and_empty_services(spark, service, monkeypatch):
    url, table, _ = service
    ends = {"n": 25}
    monkeypatch.setattr(rest, "fetch", lambda config, params: {"data": list(range(ends["n"]))[params["offset"] : params["offset"] + min(4, params["limit"])], "total": 25})
    config = {"url": "u", "pagination": "offset", "page_size": 10, "num_partitions": 3}
    parts = rest.planned(config)
    assert [r for p in parts for page in rest.read_range(config, p) for r in page] == list(range(25))
    ends["n"] = 27  # grows after the plan: the last range goes on
    assert [r for p in parts for page in rest.read_range(config, p) for r in page] == list(range(27))
    ends["n"] = 7
    with pytest.raises(RuntimeError):
        [r for p in parts for page in rest.read_range(config, p) for r in page]
    ends["n"] = 0
    assert rest.planned(config) == [] and list(rest.pages(config)) == []
    with pytest.raises(RuntimeError):
        ends["n"] = 25
        rest.planned(config | {"max_pages": 6})
    assert rest.total_of({"meta": {"total": True}}, "meta.total") is None and rest.total_of([1], "total") is None


DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def skewed(spark):
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:splits;create=true"
    n = spark.range(4000)
    value = F.when(n.id < 3000, n.id % 700).when(n.id < 3900, 10**6 + n.id * 997).when(n.id < 3980, F.lit(10**12) + n.id)
    n.select("id", value.alias("k"), (value / 7).alias("d"), F.lit("x").alias("s"), F.when(n.id < 2500, 5).otherwise(n.id).alias("hot")).coalesce(1).write.format("jdbc").options(url=url, dbtable="skewed", driver=DRIVER).save()
    return {"connection_string": url, "driver": DRIVER, "table": "skewed", "schema": ""}


@pytest.mark.parametrize("column", ["k", "d", "id"])
def test_even_splits_of_skewed_values(spark, skewed, column):
    got = readers.read_source(spark, "jdbc", skewed | {"partition_column": column, "num_partitions": 8})
    sizes = [r["n"] for r in got.filter(F.col(column).isNotNull()).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert got.count() == 4000 and sorted(r["id"] for r in got.collect()) == list(range(4000))
    assert len(sizes) == 8 and max(sizes) <= 1.5 * sum(sizes) / 8
    wide = readers.read_source(spark, "jdbc", skewed | {"partition_column": column, "num_partitions": 8, "lower_bound": 0, "upper_bound": 10**12})
    assert column == "id" or max(r["n"] for r in wide.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) > 3000


def test_splits_of_one_hot_value_nulls_and_bad_columns(spark, skewed):
    got = readers.read_source(spark, "jdbc", skewed | {"partition_column": "hot", "num_partitions": 6, "columns": ["hot", "id"]})
    sizes = sorted(r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert got.count() == 4000 and sizes[-1] <= 2600 and len(sizes) >= 3 and got.columns == ["hot", "id"]
    with pytest.raises(readers.ConfigError):
        readers.read_source(spark, "jdbc", skewed | {"partition_column": "s", "num_partitions": 2})
    for asked, want in (([(None, None, 0, 3)], ["c IS NULL"]), ([(None, None, 0, 0)], ["c IS NOT NULL"]), ([(4, 4, 9, 9)], ["c IS NOT NULL"])):
        assert jdbc_splits.conditions(lambda q, asked=asked: asked, "t", "c", 4, True) == want
    assert rows(readers.read_source(spark, "jdbc", skewed | {"partition_column": "id", "num_partitions": 1}).filter("id = 7"))[0]["k"] == 7
