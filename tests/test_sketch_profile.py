"""Mergeable profiles against exact ones, and the records of profiles, reports and merges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import profile, sketch_profile
from sluiceway.plans.keyed_files import KeyedFiles
from sluiceway.plans.pipeline import Services

from .conftest import DATA, rows


def test_merged_states_say_what_the_whole_says(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_quantity", F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice")).alias("price"), "l_returnflag", "l_shipdate", F.array("l_linenumber").alias("nested"))
    parts = [sketch_profile.profile_states(lines.filter(F.col("l_orderkey") % 3 == i)) for i in range(3)] + [sketch_profile.profile_states(lines.limit(0))]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    got = {r["column"]: r for r in rows(sketch_profile.estimates(sketch_profile.merged(states)))}
    whole = {r["column"]: r for r in rows(sketch_profile.estimates(sketch_profile.profile_states(lines)))}
    exact = {r["column"]: r for r in rows(profile.numeric_profile(lines))}
    cards = {r["column"]: r["cardinality"] for r in rows(profile.cardinality(lines))}
    gaps = {r["column"]: r["missing"] for r in rows(profile.missing_values(lines))}
    n = lines.count()
    assert set(got) == set(lines.columns) and all(got[c]["missing"] == gaps[c] and got[c]["count"] == n - gaps[c] for c in got)
    for c, e in exact.items():
        assert float(got[c]["min"]) == e["min"] and float(got[c]["max"]) == e["max"]
        assert abs(got[c]["mean"] - e["mean"]) < 1e-9 * abs(e["mean"]) and abs(got[c]["std"] - e["std"]) < 1e-6 * e["std"]
        for q, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            below, upto = (lines.filter(F.col(c) < got[c][q]).count(), lines.filter(F.col(c) <= got[c][q]).count())
            assert below / e["count"] - 3 * sketch_profile.RANK_ERROR <= share <= upto / e["count"] + 3 * sketch_profile.RANK_ERROR
    for c, k in cards.items():
        assert abs(got[c]["cardinality"] - k) <= max(1, 4 * sketch_profile.DISTINCT_ERROR * k)
        assert abs(got[c]["cardinality"] - whole[c]["cardinality"]) <= max(1, 4 * sketch_profile.DISTINCT_ERROR * k)
    flags = {r["l_returnflag"]: r["n"] for r in lines.groupBy("l_returnflag").agg(F.count("*").alias("n")).collect()}
    assert {v["value"]: v["count"] for v in got["l_returnflag"]["top_values"]} == flags
    assert (got["l_shipdate"]["min"], got["l_shipdate"]["q1"], got["nested"]["cardinality"]) == (str(lines.agg(F.min("l_shipdate")).first()[0]), None, 0)
    assert sketch_profile.profile_states(spark.range(1).select()).count() == 0


def test_batches_of_a_dataset_and_records(spark, tmp_path):
    s = Services(spark, f"{tmp_path}/root", "acme")
    for i in range(2):
        spark.range(i * 100, i * 100 + 100).select("id", F.lit(f"b{i}").alias("b")).write.parquet(f"{tmp_path}/b{i}")
        s.profile_batch("d", f"b{i}", f"{tmp_path}/b{i}")
    s.profile_batch("d", "b1", f"{tmp_path}/b1")  # again: it counts once
    got = {r["column"]: r for r in rows(s.dataset_profile("d"))}
    assert (got["id"]["count"], float(got["id"]["max"]), got["id"]["mean"], got["b"]["cardinality"]) == (200, 199.0, 99.5, 2)
    assert Services(spark, f"{tmp_path}/root", "other").dataset_profile("d").count() == 0
    done = s.profile(f"{tmp_path}/b0")
    found = s.find_profile(done.details["profile_id"])
    assert found == s.find_profile(job_id=done.job_id) and (found["row_count"], found["column_count"]) == (100, 2) and found["parts"]["numeric"][0]["max"] == 99.0
    checked = s.check_quality(f"{tmp_path}/b0", [{"column": "id", "threshold": 2.0}])
    report = s.find_report(job_id=checked.job_id)
    assert (report["status"], report["results"][0]["rule"], report["report_id"]) == ("failed", "completeness_id", checked.details["report_id"])
    for look in (s.find_profile, s.find_report):
        with pytest.raises(KeyError):
            look("nothing")


def test_services_over_versions_and_file_tables(spark, tmp_path):
    s = Services(spark, f"{tmp_path}/root", "acme")
    schema = "k int, v string, updated_at string, is_deleted boolean"
    base = spark.createDataFrame([(i, "old", "2024-01-01", False) for i in range(10)], schema)
    table = KeyedFiles(spark, f"{tmp_path}/table", rows_per_file=5)
    table.create(base, ["k"])
    spark.createDataFrame([(3, "new", "2024-01-05", False), (3, "newer", "2024-01-06", False), (4, None, "2024-01-04", True), (50, "in", "2024-01-03", None)], schema).write.parquet(f"{tmp_path}/delta")
    config = {"table_name": "t", "cdc_mode": "soft_delete"}
    done = s.merge_files(f"{tmp_path}/delta", f"{tmp_path}/table", config).details
    assert (done["inserted_rows"], done["updated_rows"], done["deleted_rows"]) == (1, 1, 1) and done["watermark"].startswith("2024-01-06")
    assert {r["k"]: r["v"] for r in table.read().collect()} == {i: "old" for i in range(10) if i not in (3, 4)} | {3: "newer", 50: "in"}
    again = s.merge_files(f"{tmp_path}/delta", f"{tmp_path}/table", config).details
    assert again["version"] == done["version"] and again["inserted_rows"] == 0
    version = s.snapshot(f"{tmp_path}/delta", ["k", "updated_at"], {"why": "test"})
    assert s.store().list().first()["version"] == version and s.store().restore(version).count() == 4
