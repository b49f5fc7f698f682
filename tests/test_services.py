"""Alerts, metric history, lineage, schedules, exporters, limits of requests."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sluiceway.plans.pipeline import Services
from sluiceway.plans.plugins import PluginRegistry
from sluiceway.sources import rest
from sluiceway.streaming import microbatch


class TableExporter:
    """Stands in for a plugin class."""

    def export(self, df, config):
        df.write.parquet(config["path"])
        return config["path"]


@pytest.fixture
def receiver():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", got
    server.shutdown()


def test_alerts_and_history(spark, tmp_path, receiver):
    url, got = receiver
    s = Services(spark, str(tmp_path / "root"), "acme")
    uri = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.parquet(uri)
    assert s.alerts().count() == 0 and s.monitoring().count() == 0
    rules = [{"column": "v", "threshold": 0.9}, {"column": "k", "threshold": 1.0}, {"name": "quiet", "column": "v", "threshold": 0.8, "alert_on_failure": False}]
    out = s.check_quality(uri, rules, webhook=url)
    assert out.status == "failed" and out.details["webhook_calls"] == 1 and [g["rule"] for g in got] == ["completeness_v"]
    assert [(r["rule"], r["metric"]) for r in s.alerts().collect()] == [("completeness_v", 0.5)]
    s.check_quality(uri, rules[1:2])
    seen = {r["key"]: (r["n"], r["latest"], r["is_anomaly"]) for r in s.monitoring().collect()}
    assert seen["acme__completeness_" + "_k"] == (2, 1.0, False)
    assert Services(spark, str(tmp_path / "root"), "other").metric_history().count() == 0


def test_lineage_and_run_events(spark, tmp_path, receiver):
    url, got = receiver
    s = Services(spark, str(tmp_path), "acme")
    s.record_stage("one", ["a"], "b", {"x": ["y"]})
    s.record_stage("two", ["b"], "c", {"z": ["x"]})
    s.record_stage("back", ["c"], "a")
    parts = s.lineage("b", "x")
    assert {r["uri"]: r["depth"] for r in parts["upstream"].collect()} == {"a": 1, "c": 2}
    assert {r["uri"]: r["depth"] for r in parts["downstream"].collect()} == {"c": 1, "a": 2}
    assert [(r["uri"], r["field"]) for r in parts["field"].collect()] == [("a", "y")]
    assert s.publish_runs(url) == 3 and s.publish_runs(url) == 0
    assert sorted(g["job"]["name"] for g in got) == ["back", "one", "two"]


def test_schedules_and_runs(spark, tmp_path):
    s = Services(spark, str(tmp_path), "acme")
    assert s.schedule("p", "0 3 * * *", ["b", "a"], {"b": ["a"]}) == ["a", "b"]
    s.schedule("q", "0 2 * * *", ["a"])
    assert s.upcoming(datetime(2024, 1, 1)) == [(datetime(2024, 1, 1, 2), "q"), (datetime(2024, 1, 1, 3), "p")]
    with pytest.raises(ValueError):
        s.schedule("r", "61 * * * *", ["a"])
    done = []
    s.run_pipeline("p", {"a": lambda: done.append("a"), "b": lambda: done.append("b")})
    assert done == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        s.run_pipeline("q", {"a": lambda: 1 / 0})
    assert [r["status"] for r in s.runs("p").collect()] == ["completed"] and [r["status"] for r in s.runs("q").collect()] == ["failed"]
    s.schedule("q", "0 2 * * *", ["a"], active=False)
    assert [p for _, p in s.upcoming(datetime(2024, 1, 1))] == ["p"]


def test_exporter(spark, tmp_path):
    s = Services(spark, str(tmp_path / "root"), "acme")
    uri, target = f"{tmp_path}/t", f"{tmp_path}/out"
    spark.range(5).write.parquet(uri)
    plugins = PluginRegistry((__name__,))
    plugins.register("table", "exporter", "1", __name__, "TableExporter", "acme", {"required": ["path"]})
    assert s.export(plugins, "table", uri, {"path": target}).output_uri == target and spark.read.parquet(target).count() == 5
    with pytest.raises(ValueError):
        s.export(plugins, "table", uri)
    with pytest.raises(KeyError):
        plugins.named("other", "table")


def test_pages_never_fall_short(monkeypatch):
    rows = list(range(25))
    monkeypatch.setattr(rest, "fetch", lambda config, params: {"data": rows[params["offset"] : params["offset"] + 4]})
    read = lambda **more: [r for page in rest.pages({"url": "u", "pagination": "offset", "page_size": 10} | more) for r in page]
    assert read() == rows
    with pytest.raises(RuntimeError):
        read(max_pages=3)


def test_stream_request_ends_at_its_size(spark, tmp_path):
    for i in range(6):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema("id bigint").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = 0
    for _ in range(10):
        out = microbatch.ingest_stream_batch(spark, {"output_path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark", "batch_size": 20, "timeout_seconds": 60}, read())
        seen += out["message_count"]
        if not out["message_count"]:
            break
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == 60


def test_stream_reservoir(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    microbatch.stream_reservoir(stream, 10, ["id"], f"{tmp_path}/out", f"{tmp_path}/mark")
    from sluiceway.operators.sample import random_sample

    expected = random_sample(spark.range(100), 10, ["id"])
    last = spark.read.parquet(f"{tmp_path}/out/v3")
    assert sorted(r["id"] for r in last.collect()) == sorted(r["id"] for r in expected.select(F.col("id")).collect())
