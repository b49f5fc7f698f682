"""An ordered log read by offsets, and the newest row of a key over it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sluiceway.plans.keyed_files import KeyedFiles
from sluiceway.sources import ordered_log as logs
from sluiceway.streaming import microbatch, newest

from .conftest import DATA, rows


def numbers(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") % 5).alias("g"))


def consume(spark, path, mark, **options):
    seen = []
    progress = logs.drain(logs.stream_log(spark, path, mark, **options), mark, lambda batch, n: seen.append(sorted(r["offset"] for r in batch.collect())))
    return [s for s in seen if s], progress


def test_earliest_latest_and_resume(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert logs.log_end(spark, path) == 0 and logs.read_log(spark, path).count() == 0
    assert logs.append_log(numbers(spark, 0, 100), path, ["id"], per_file=30) == 100
    assert logs.append_log(numbers(spark, 0, 0), path, ["id"]) == 100
    assert logs.append_log(numbers(spark, 100, 150), path, ["id"], per_file=30) == 150
    whole = rows(logs.read_log(spark, path), "offset")
    assert len(whole) == 150 and all(f'"id":{r["offset"]},' in r["value"] for r in whole)
    assert sorted(r["offset"] for r in logs.read_log(spark, path, 95, 105).collect()) == list(range(95, 105))
    a, b, c = (f"{tmp_path}/{x}" for x in "abc")
    got, _ = consume(spark, path, a, max_rows=40)
    assert [len(g) for g in got] == [40, 40, 40, 30] and sum(got, []) == list(range(150))
    assert logs.committed(spark, a) == 150 and logs.committed(spark, b) is None
    assert consume(spark, path, b, starting="latest")[0] == []
    assert consume(spark, path, c, starting=140)[0] == [list(range(140, 150))]
    logs.append_log(numbers(spark, 150, 225), path, ["id"])
    assert [len(g) for g in consume(spark, path, a, max_rows=40)[0]] == [40, 35]
    assert sum(consume(spark, path, b, starting="latest")[0], []) == list(range(150, 225))
    assert consume(spark, path, a, max_rows=40)[0] == [] and logs.committed(spark, a) == 225


def test_messages_decode_like_the_queue_s(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(50)
    logs.append_log(events, f"{tmp_path}/log", ["event_id"])
    stream = logs.stream_log(spark, f"{tmp_path}/log", f"{tmp_path}/mark")
    out = microbatch.ingest_stream_batch(spark, {"output_path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark", "schema": "event_id bigint, ts timestamp_ntz, value double", "json_options": logs.JSON_TIMES, "timeout_seconds": 120}, stream)
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "ts", "value")
    assert out["message_count"] == 50 and rows(got, "event_id") == rows(events.select("event_id", "ts", "value"), "event_id")


def feed(spark, path, mark, max_rows=0):
    value = logs.stream_log(spark, path, mark, max_rows=max_rows)
    return value.select("offset", F.from_json("value", "k string, t timestamp, v int", logs.JSON_TIMES).alias("r")).select("offset", "r.*")


def test_newest_row_with_late_rows_expiry_and_replay(spark, tmp_path):
    path, mark, out = (f"{tmp_path}/{x}" for x in ("log", "mark", "out"))
    schema = "n int, k string, t timestamp, v int"
    table = lambda data: spark.createDataFrame(data, "n int, k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    logs.append_log(table([(0, "a", "2024-01-01 10:00:00.000001", 1), (1, "b", "2024-01-01 10:01:00", 2), (2, "a", "2024-01-01 09:59:00", 3), (3, None, "2024-01-01 10:00:30", 9)]), path, ["n"])
    run = lambda: newest.keep_newest(feed(spark, path, mark, 2), out, mark, ["k"], "t", "offset", "10 minutes", "2 hours")
    now = lambda: {r["k"]: r["v"] for r in newest.newest_rows(spark, out, "offset bigint, " + schema[7:], ["k"]).collect()}
    run()
    assert now() == {"a": 1, "b": 2, None: 9}
    # A newer row, a late one of another key, and one with the same time and a higher offset.
    logs.append_log(table([(4, "b", "2024-01-01 10:55:00", 4), (5, "c", "2024-01-01 10:50:00", 5), (6, "b", "2024-01-01 10:55:00", 6)]), path, ["n"])
    run()
    assert now() == {"a": 1, "b": 6, "c": 5, None: 9}
    # The last batches run again: their commits are gone, as after a crash.
    for folder in ("commits",):
        last = max(int(f) for f in os.listdir(f"{mark}/{folder}") if f.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{mark}/{folder}/{name}"):
                os.remove(f"{mark}/{folder}/{name}")
    before = spark.read.parquet(out).count()
    run()
    assert now() == {"a": 1, "b": 6, "c": 5, None: 9} and spark.read.parquet(out).count() == before
    # Time passes: keys two hours behind the watermark are given up.
    logs.append_log(table([(7, "d", "2024-01-01 12:30:00", 7)]), path, ["n"])
    run()
    assert now() == {"b": 6, "c": 5, "d": 7}


def test_stream_merged_into_files_once(spark, tmp_path):
    path, mark = f"{tmp_path}/log", f"{tmp_path}/mark"
    logs.append_log(spark.range(60).select((F.col("id") % 20).alias("k"), F.timestamp_seconds(F.col("id")).alias("t"), F.col("id").alias("v")), path, ["v"])
    table = KeyedFiles(spark, f"{tmp_path}/table", rows_per_file=10)
    table.create(spark.createDataFrame([(k, None, -1) for k in range(30)], "k long, t timestamp, v long"), ["k"])
    stream = lambda: logs.stream_log(spark, path, mark, max_rows=35).select(F.from_json("value", "k long, t timestamp, v long", logs.JSON_TIMES).alias("r")).select("r.*")
    newest.merge_stream(stream(), table, mark, ["k"], "t", "s", "v = 59")
    want = {k: 40 + k for k in range(19)} | {k: -1 for k in range(20, 30)}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    version = table.state()["version"]
    last = max(int(f) for f in os.listdir(f"{mark}/commits") if f.isdigit())
    os.remove(f"{mark}/commits/{last}")
    if os.path.exists(f"{mark}/commits/.{last}.crc"):
        os.remove(f"{mark}/commits/.{last}.crc")
    newest.merge_stream(stream(), table, mark, ["k"], "t", "s", "v = 59")
    assert table.state()["version"] == version and {r["k"]: r["v"] for r in table.read().collect()} == want
    with pytest.raises(KeyError):
        table.read(version + 1)
