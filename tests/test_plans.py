"""Sources, sinks, streams, services and schedules."""

from __future__ import annotations

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from sluiceway.plans import jobs, plugins, schedule, versions, watermarks
from sluiceway.plans.pipeline import Services
from sluiceway.sources import readers, rest, sinks
from sluiceway.streaming import microbatch

from .conftest import DATA, rows


@pytest.fixture(scope="module")
def nation(spark):
    return spark.read.parquet(f"{DATA}/nation.parquet")


def test_formats_round_trip(spark, nation, tmp_path):
    for kind in ("parquet", "csv", "json", "orc"):
        path = sinks.write_format(nation, f"{tmp_path}/{kind}", kind)
        back = readers.read_path(spark, path, kind, {"schema": nation.schema} if kind in ("csv", "json") else {})
        assert rows(back, "n_nationkey") == rows(nation, "n_nationkey")
    path = sinks.write_format(nation, f"{tmp_path}/arrow", "arrow")
    assert rows(sinks.read_arrow(spark, path, "n_nationkey int, n_name string, n_regionkey int"), "n_name") == rows(nation, "n_name")
    assert sinks.arrow_bytes(nation)[:6] == b"ARROW1"
    with pytest.raises(readers.ConfigError):
        sinks.write_format(nation, "x", "xml")
    sinks.convert_format(spark, f"{tmp_path}/csv", "csv", f"{tmp_path}/again", "parquet")
    assert spark.read.parquet(f"{tmp_path}/again").count() == 25


def test_readers(spark, tmp_path):
    assert readers.file_format("a.PQ") == "parquet" and readers.file_format("a.txt") == "csv"
    assert readers.validate_connection(spark, "file", {"file_path": f"{tmp_path}/none.csv"}) is False
    with pytest.raises(readers.ConfigError):
        readers.read_source(spark, "tape", {})
    (tmp_path / "v.csv").write_text("a;b\n1;x\n2;\n")
    got = rows(readers.read_source(spark, "csv", {"file_path": f"{tmp_path}/v.csv", "format": "csv", "delimiter": ";", "columns": ["b", "a"]}), "a")
    assert got == [{"b": "x", "a": 1}, {"b": None, "a": 2}]
    assert readers.read_source(spark, "s3", {"scheme": "file", "bucket": str(DATA), "key": "nation.parquet"}).count() == 25
    assert readers.read_source(spark, "sql", {"query": "SELECT 1 AS a"}).first()["a"] == 1
    assert readers.redacted({"secret_key": "x", "key": "k", "password": "p"}) == {"secret_key": "***", "key": "k", "password": "***"}
    assert readers.warehouse_options("snowflake", {"account": "a", "query": "q"}) == {"sfURL": "a", "query": "q"}


def test_jdbc(spark, nation, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    nation.write.format("jdbc").options(url=url, dbtable="nation", driver=driver).save()
    config = {"connection_string": url, "driver": driver}
    assert readers.read_source(spark, "jdbc", config | {"table": "nation", "schema": "", "columns": ["n_name"]}).count() == 25
    assert readers.read_source(spark, "jdbc", config | {"query": 'SELECT "n_name" FROM nation WHERE "n_nationkey" < 3'}).count() == 3
    with pytest.raises(readers.ConfigError):
        readers.read_source(spark, "postgres", config)


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        data, body = [{"id": i} for i in range(25)], None
        if "page" in q:
            n, size = int(q["page"]), int(q["page_size"])
            body = {"data": data[(n - 1) * size : n * size]}
        elif "offset" in q:
            body = {"data": data[int(q["offset"]) :][: int(q["limit"])]}
        elif self.path.startswith("/cursor"):
            at = int(q.get("cursor", 0))
            body = {"data": data[at : at + 7], "next_cursor": at + 7 if at + 7 < 25 else None}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body if body is not None else data).encode())

    def log_message(self, *_):
        pass


def test_rest(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    for config in ({"url": url}, {"url": url, "pagination": "page", "page_size": 10}, {"url": url, "pagination": "offset", "page_size": 10}, {"url": url + "/cursor", "pagination": "cursor"}):
        got = readers.read_source(spark, "rest", config | {"schema": "id bigint"})
        assert sorted(r["id"] for r in got.collect()) == list(range(25))
    server.shutdown()
    assert rest.records({"rows": [1]}, "rows") == [1] and rest.records({"data": 5}) == []


def test_stream_restart_loses_and_doubles_nothing(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    run = lambda: microbatch.ingest_stream_batch(spark, {"output_path": out, "checkpoint": mark, "timeout_seconds": 120}, spark.readStream.schema(events.schema).parquet(source))
    events.filter("event_id % 2 = 0").write.parquet(source)
    assert run()["finished"]
    events.filter("event_id % 2 = 1").write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    with pytest.raises(ValueError):
        microbatch.ingest_stream_batch(spark, {"batch_size": 0})


def test_decoding_and_kafka_options(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("[1]",), ("{bad",), ("7",)], "value string")
    assert [(r["k"], r["scalar_value"], r["is_valid"]) for r in microbatch.decode_json(df, "k bigint").collect()] == [(1, None, True), (None, "[1]", True), (None, None, False), (None, "7", True)]
    options = microbatch.kafka_options({"bootstrap_servers": "b", "topic": "t", "username": "u", "password": "p"})
    assert options["kafka.security.protocol"] == "SASL_SSL" and options["maxOffsetsPerTrigger"] == "1000"


def test_services_end_to_end(spark, tmp_path):
    s = Services(spark, str(tmp_path), "acme")
    raw = s.ingest("parquet", {"file_path": f"{DATA}/customer.parquet", "format": "parquet", "password": "hush"})
    assert raw.row_count == 150
    assert s.profile(raw.output_uri).details["numeric"]
    out = s.orchestrate({"input_uri": raw.output_uri, "cleaning": {"normalize": ["c_acctbal"]}, "transform": {"rename": {"c_name": "name"}}, "suite": {}})
    assert "name" in spark.read.parquet(out.output_uri).columns and out.details["quality_score"] == 1.0
    assert versions.get_version(spark, f"{tmp_path}/meta", out.details["data_version"], "acme")["row_count"] == 150
    with pytest.raises(KeyError):
        versions.get_version(spark, f"{tmp_path}/meta", "nothing", "acme")
    with pytest.raises(ValueError):
        s.orchestrate({"input_uri": raw.output_uri, "skip_profile": True, "suite": {"expectations": [{"expectation_type": "expect_table_row_count_to_equal", "kwargs": {"value": 1}}]}})
    assert s.clean(raw.output_uri, {"drop_cols": ["c_name"]}).details["column_count"] == 4
    assert s.transform(raw.output_uri, {"interactions": [["c_custkey", "c_acctbal"]]}).row_count == 150
    assert s.sample(raw.output_uri, {"sample_size": 30, "keys": ["c_custkey"]}).row_count == 30
    assert s.deidentify(raw.output_uri, {"columns": {"c_name": {}}}).details["risk_score"] >= 0
    assert s.check_quality(raw.output_uri, [{"column": "c_name", "threshold": 2.0}]).status == "failed"
    counts = jobs.dashboard(s.records.jobs("acme"), 50).first()
    assert counts["failed"] == 2 and counts["jobs"] == counts["failed"] + counts["completed"]
    assert s.records.jobs("other").count() == 0 and s.records.find("acme", raw.job_id)["status"] == "completed"
    assert "hush" not in "".join(r["source_config"] for r in s.records.jobs("acme").collect())
    assert jobs.versions(s.records.jobs("acme")).count() == 1 and s.edges().count() == 2


def test_watermark_follows_the_data(spark, tmp_path):
    source = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-06")], "id int, updated_at string")
    got = watermarks.run_load(spark, str(tmp_path), source, None, {"table_name": "t"}, f"{tmp_path}/a")
    marks = watermarks.Watermarks(spark, str(tmp_path))
    assert got.inserted_rows == 2 and marks.get("t").startswith("2024-01-06")
    with pytest.raises(Exception, match="(?i)exists"):
        watermarks.run_load(spark, str(tmp_path), source.withColumn("updated_at", source.updated_at), None, {"table_name": "u"}, f"{tmp_path}/a")
    assert marks.get("u") == watermarks.EPOCH
    marks.reset("t")
    assert marks.get("t") == watermarks.EPOCH


def test_content_hash_ignores_order(spark, nation):
    assert versions.content_hash(nation) == versions.content_hash(nation.orderBy("n_name").select("n_name", "n_regionkey", "n_nationkey"))
    assert versions.content_hash(nation)[0] != versions.content_hash(nation.limit(24))[0]


def test_stages_and_texts():
    needs = {"b": ["a"], "c": ["a"], "d": ["b", "c"]}
    assert schedule.stage_order(["d", "c", "b", "a"], needs) == ["a", "c", "b", "d"]
    with pytest.raises(ValueError, match="cycle"):
        schedule.stage_order(["a", "b"], {"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="unknown"):
        schedule.stage_order(["a"], {"a": ["z"]})
    config = {"pipeline_id": "p", "stages": ["a", "b"], "dependencies": {"b": ["a"]}}
    compile(schedule.airflow_dag(config, "t"), "dag", "exec")
    assert [a["name"] for a in schedule.temporal_workflow(config, "t")["activities"]] == ["a", "b"]


def test_cron():
    at = datetime(2024, 2, 28, 23, 59)
    assert schedule.next_runs("0 0 29 2 *", at, 2) == [datetime(2024, 2, 29), datetime(2028, 2, 29)]
    assert schedule.next_runs("0 12 13 * 5", at, 3) == [datetime(2024, 3, 1, 12), datetime(2024, 3, 8, 12), datetime(2024, 3, 13, 12)]
    assert schedule.cron_values("1-5,10,*/20", "minute", 0, 59) == {0, 1, 2, 3, 4, 5, 10, 20, 40}
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *"):
        assert schedule.validate_cron(bad)["valid"] is False
    assert schedule.validate_cron("0 * * * *")["description"] == "Every hour at minute 0" and len(schedule.validate_cron("@daily")["next_runs"]) == 5


def test_run_history(spark, tmp_path):
    records = jobs.Records(spark, str(tmp_path))
    for run, status in (("r1", "running"), ("r1", "completed"), ("r2", "running")):
        schedule.track_run(records, "p", run, status)
    got = schedule.run_history(records.read("pipeline_runs", schedule.RUNS), "p")
    assert [(r["run_id"], r["status"]) for r in got.collect()] == [("r2", "running"), ("r1", "completed")]


def test_plugins():
    registry = plugins.PluginRegistry(("collections",))
    p = registry.register("c", "transformer", "1", "collections", "OrderedDict", "t")
    assert registry.load(p.plugin_id) == {} and registry.list("t", "transformer") == [p] and registry.list("u") == []
    with pytest.raises(ValueError):
        registry.register("c", "transformer", "1", "x", "y", "t")
    with pytest.raises(ValueError):
        registry.register("d", "spell", "1", "x", "y", "t")
    bad = registry.register("e", "exporter", "1", "os", "system", "t")
    with pytest.raises(PermissionError):
        registry.load(bad.plugin_id)
    with pytest.raises(PermissionError):
        registry.deregister(p.plugin_id, "u")
    registry.deregister(p.plugin_id, "t")
    with pytest.raises(KeyError):
        registry.get(p.plugin_id)
