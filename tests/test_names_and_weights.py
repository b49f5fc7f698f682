"""Columns that share a helper's name stay, and importance samples of any weights."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sluiceway.functions import tables
from sluiceway.functions.columns import unused
from sluiceway.operators import clean, deidentify, features, incremental, monitor, sample
from sluiceway.plans import jobs
from sluiceway.plans.pipeline import Services
from sluiceway.sources import readers, rest

from .conftest import rows

CLASHES = ["place", "_place", "means", "best", "value", "label", "text", "stats", "draw", "row_id", "in_s", "in_d", "gone_0", "scores", "raw_vector", "part_0", "__masked_note", "masked_text"]


@pytest.fixture(scope="module")
def crowded(spark):
    """Twenty rows whose columns have the names that operators would like for themselves."""
    return spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("note"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("x"), *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in CLASHES])


def same(got, want, but=()):
    keep = [c for c in want.columns if c not in but]
    assert rows(got.select(*keep), "place") == rows(want.select(*keep), "place")


def test_names_that_clash(spark, crowded):
    assert unused(crowded, "place") == "__place" and unused(crowded, "PLACE") == "__PLACE"
    same(clean.deduplicate(crowded, ["id"]), crowded)
    for how in ("mean", "median", "mode"):
        assert all(v is not None for r in rows(clean.impute(crowded, how)) for v in r.values())
        same(clean.impute(crowded, how), crowded, ["x", "id"] if how != "mode" else ["x"])
    same(clean.normalise(crowded, {"x": "minmax"}), crowded, ["x"])
    assert {r["place"] for r in rows(clean.label_encode(crowded, "place"))} == set(range(20))
    same(clean.label_encode(crowded, "note"), crowded, ["note"])
    same(sample.random_sample(crowded, 50, ["id"]), crowded)
    same(sample.stratified_sample(crowded, 50, "note", ["id"]), crowded)
    same(sample.systematic_sample(crowded, ["id"], step=1), crowded)
    same(sample.importance_sample(crowded, 5, "x", ["id"]), crowded.join(sample.importance_sample(crowded, 5, "x", ["id"]).select("id"), "id", "left_semi"))
    same(incremental.latest(crowded, ["id"], "x", "sequence"), crowded)
    same(incremental.upsert(crowded, crowded.limit(3), ["id"]), crowded)
    assert incremental.remove_keys(crowded, crowded.limit(3), ["id"]).count() == 17
    wide = crowded.withColumn("y", -F.col("id").cast("double"))
    got = features.pca(wide, ["x", "y"], 2)
    same(got, wide.drop("x", "y"))
    hidden = deidentify.deidentify(crowded, {"columns": {"note": {"entity_types": ["SSN"]}}}, "job")
    same(hidden.dataframe, crowded)
    assert hidden.audit_log.first()["masked_values"] == 0
    history = crowded.select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.col("x").alias("value"), "place")
    assert monitor.recent(history, 3).columns == history.columns and monitor.recent(history, 3).count() == 3
    assert jobs.current(crowded, ["note"], "id").columns == crowded.columns


def test_row_numbers_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(sample, "HELD", 50)
    table = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("place"))
    got = sorted(rows(sample.with_row_id(table, ["g", "k"], "n")), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1000)) and [(r["g"], r["k"]) for r in got] == sorted((r["g"], r["k"]) for r in got)


def test_weights_of_many_sizes(spark):
    """A draw doesn't hang on the weights' scale, and single draws have the weights' shares."""
    base = spark.range(300).withColumn("w", (F.col("id") % 5 + 1).cast("double"))
    drawn = [rows(sample.importance_sample(base.withColumn("w", F.col("w") * scale), 40, "w", ["id"]).select("id"), "id") for scale in (1e-12, 1.0, 1e9, 1e15)]
    assert all(d == drawn[0] for d in drawn) and len(drawn[0]) == 40 and max(r["id"] for r in drawn[0]) > 200
    mixed = spark.range(12).withColumn("w", F.pow(F.lit(10.0), (F.col("id") % 3 - 1) * 0.5))
    counts: dict[int, int] = {}
    whole = sum(10 ** ((i % 3 - 1) * 0.5) for i in range(12))
    for seed in range(0, 60, 10):
        parts = [sample.importance_sample(mixed, 1, "w", ["id"], seed=s).select("id") for s in range(seed, seed + 10)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        for r in out.collect():
            counts[r["id"] % 3] = counts.get(r["id"] % 3, 0) + 1
    n = sum(counts.values())
    for kind in range(3):
        p = 4 * 10 ** ((kind - 1) * 0.5) / whole
        assert abs(counts.get(kind, 0) / n - p) < 4 * math.sqrt(p * (1 - p) / n)


def test_tenants_whose_names_share_a_start(spark, tmp_path):
    uri = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.parquet(uri)
    for tenant in ("a", "a__b"):
        Services(spark, f"{tmp_path}/root", tenant).check_quality(uri, [{"column": "v", "name": "one"}, {"column": "v", "name": "two"}])
    history = Services(spark, f"{tmp_path}/root", "a").metric_history()
    assert [r["key"] for r in history.collect()] == ["a__completeness__v"] and history.columns == ["key", "seq", "value"]


def test_exactly_as_many_pages_as_allowed(monkeypatch):
    found = list(range(20))
    monkeypatch.setattr(rest, "fetch", lambda config, params: {"data": found[(params["page"] - 1) * 5 : params["page"] * 5]})
    config = {"url": "u", "pagination": "page", "page_size": 5}
    assert [r for p in rest.pages(config | {"max_pages": 4}) for r in p] == found
    with pytest.raises(RuntimeError):
        list(rest.pages(config | {"max_pages": 3}))


def test_session_keeps_its_catalogue(spark, tmp_path):
    before = spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE elsewhere LOCATION '{tmp_path}'")
    spark.sql("CREATE VIEW elsewhere.v AS SELECT 7 AS a")
    assert readers.read_source(spark, "sql", {"query": "SELECT a FROM v", "schema": "elsewhere"}).first()["a"] == 7
    with pytest.raises(Exception, match="v"):
        readers.read_source(spark, "sql", {"query": "SELECT a FROM nowhere_v", "schema": "elsewhere"})
    assert spark.catalog.currentDatabase() == before
    spark.sql("DROP DATABASE elsewhere CASCADE")


def test_risk_threshold(spark):
    df = spark.createDataFrame([(i, f"user {i}") for i in range(10)], "i int, t string")
    for limit, above in ((0.2, True), (0.3, False)):
        seen = deidentify.deidentify(df, {"columns": {}, "risk_threshold": limit}, "job").risk.first()
        assert (seen["risk_score"], seen["above_threshold"]) == (0.3, above)


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def __init__(self, master):
            self.conf = {"spark.master": master}

        def get(self, key, default=None):
            return self.conf.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert "spark-tables-" in tables.shared_path(Session("local[4]"), "x")
    for master in ("local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            tables.shared_path(Session(master), "x")


def test_versions_of_all_jobs(spark):
    table = spark.createDataFrame([(f"j{i}", f"v{i}" if i < 3 else None, f"2024-01-{i + 1:02}") for i in range(20)], "job_id string, data_version string, created_at string").withColumn("output_uri", F.lit("u")).withColumn("row_count", F.lit(1))
    assert jobs.versions(table).count() == 3 and jobs.versions(table, 10).count() == 0 and jobs.versions(table, 18).count() == 1
