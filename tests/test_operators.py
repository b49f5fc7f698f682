"""Pinned facts on small frames."""

from __future__ import annotations

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import clean, deidentify, features, gate, incremental, lineage, monitor, profile, sample

from .conftest import rows


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame([(1, 1.0, "b"), (2, 1.0, "a"), (3, None, "b"), (4, 2.0, None), (5, 2.0, "a")], "id int, num double, cat string")


def test_mode_takes_the_smaller_tie(holes):
    got = {r["id"]: r for r in rows(clean.impute(holes, "mode"))}
    assert got[3]["num"] == 1.0 and got[4]["cat"] == "a"


def test_impute_other_ways(holes):
    assert {r["id"]: r["num"] for r in rows(clean.impute(holes, "mean"))}[3] == 1.5
    assert {r["id"] for r in rows(clean.impute(holes, "drop"))} == {1, 2, 5}
    with pytest.warns(UserWarning):
        assert {r["id"]: r["num"] for r in rows(clean.impute(holes, "magic"))}[3] == 1.0


def test_null_rows_are_equal(spark):
    assert clean.deduplicate(spark.createDataFrame([(None,), (None,)], "a int")).count() == 1


def test_clip_and_remove(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    assert sorted((r["x"] for r in rows(clean.treat_outliers(df, "clip"))), key=str) == [1.0, 2.0, 3.0, 65.5, None]
    assert sorted(r["x"] for r in rows(clean.treat_outliers(df, "remove"))) == [1.0, 2.0, 3.0]
    assert clean.treat_outliers(df, "other") is df


def test_one_hot_of_null_and_width(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "q string")
    assert [tuple(r) for r in clean.one_hot(df, "q").collect()] == [(False, True), (True, False), (False, False)]
    with pytest.raises(ValueError):
        clean.one_hot(df, "q", width=1)


def test_labels_sort_as_text(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,)], "v string")
    assert sorted(r["v"] for r in rows(clean.label_encode(df, "v"))) == [0, 1, 2]


def test_constant_columns_normalise_to_zero(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, None)], "a double, b double")
    got = rows(clean.normalise(df, {"a": "zscore", "b": "minmax"}))
    assert [r["a"] for r in got] == [0.0, 0.0] and [r["b"] for r in got] == [0.0, None]


def test_constant_histogram_and_few_values(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    bins = sorted(rows(profile.histograms(df)), key=lambda r: r["bin"])
    assert (bins[0]["low"], bins[1]["low"], bins[-1]["high"], sum(r["count"] for r in bins)) == (4.5, 4.55, 5.5, 2)
    assert rows(profile.outliers(df))[0]["status"] == "insufficient data"


def test_profile_of_odd_types(spark):
    df = spark.createDataFrame([(True, [1], "x", None), (False, [2], "x", None)], "b boolean, a array<int>, s string, d double")
    kinds = {r["column"]: r["semantic_type"] for r in rows(profile.semantic_types(df))}
    assert kinds == {"b": "boolean", "a": "unknown", "s": "text", "d": "numeric"}
    assert all(v.collect() is not None for v in profile.profile(df).values())
    assert all(v.collect() is not None for v in profile.profile(df.limit(0)).values())


def test_pca_is_centred_with_fixed_sign(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), i) for i in range(30)], "x double, y double, id int")
    got = rows(features.pca(df, ["x", "y"], 2))
    assert abs(sum(r["pca_1"] for r in got)) < 1e-6 and set(got[0]) == {"id", "pca_1", "pca_2"}
    assert features.pca(df, ["x"], 2) is df


def test_polynomial_names(spark):
    out = features.polynomial(spark.createDataFrame([(2, 3)], "a int, b int"), ["a", "b"])
    assert out.columns == ["a", "b", "a^2", "a b", "b^2"] and list(out.first())[2:] == [4.0, 6.0, 9.0]


def test_sample_sizes_and_strategies(spark):
    df = spark.range(200).selectExpr("id", "id % 4 AS s", "cast(id as double) AS w")
    for strategy in ("random", "stratified", "systematic", "importance", "reservoir"):
        got = sample.sample(df, {"strategy": strategy, "sample_size": 0.1, "keys": ["id"], "stratify_column": "s", "weight_column": "w"})
        assert got.sampled_rows == 20 and got.dataframe.columns == df.columns
        assert rows(got.dataframe, "id") == rows(sample.sample(df, {"strategy": strategy, "sample_size": 0.1, "keys": ["id"], "stratify_column": "s", "weight_column": "w"}).dataframe, "id")
    with pytest.raises(ValueError):
        sample.sample(df, {"strategy": "guess"})
    with pytest.raises(ValueError):
        sample.importance_sample(df.withColumn("w", -F.col("w") - 1), 3, "w", ["id"])
    assert sample.sample(df.limit(5), {}).sampled_rows == 5
    assert sample.sample_size(10_000)["sample_size"] == 370 and sample.target_size(50, 1) == 1 and sample.target_size(50, 1.0) == 50


def test_row_ids_are_consecutive(spark):
    df = spark.range(1000).repartition(7).selectExpr("id", "-id AS k")
    got = rows(sample.with_row_id(df, ["k"]))
    assert all(r["_row_id"] == 999 - r["id"] for r in got)


TEXTS = ["mail a.b@c.example now", "ssn 123-45-6789", "call 555-123-4567 or 555.123.4568", "ip 10.0.0.1", "card 4111 1111 1111 1111", "12 Long Meadow Street", "met John Smith", "", None, "nothing here"]


def by_hand(text, strategy, key):
    if text is None:
        return None
    for entity, pattern in deidentify.PATTERNS.items():
        flags = re.IGNORECASE if pattern.startswith("(?i)") else 0
        rx = re.compile(pattern.removeprefix("(?i)"), flags)

        def one(m, entity=entity):
            v = m.group(0)
            if strategy == "hash":
                return f"[HASH:{hashlib.sha256(v.encode()).hexdigest()[:16]}]"
            if strategy == "pseudonymize":
                return "PSEUDO_" + hmac.new(key, v.encode(), hashlib.sha256).hexdigest().upper()[:12]
            return f"[{entity}_REDACTED]"

        text = rx.sub(one, text)
    return text


@pytest.mark.parametrize("strategy", ["redact", "hash", "pseudonymize"])
def test_masking_like_python(spark, strategy):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["t"] for r in rows(deidentify.deidentify(df, {"columns": {"t": {"strategy": strategy}}}, "job").dataframe)}
    key = deidentify.pseudonym_key("job")
    assert got == {i: by_hand(t, strategy, key) for i, t in enumerate(TEXTS)}


def test_known_pseudonym_and_generalised(spark):
    df = spark.createDataFrame([("123-45-6789",)], "t string")
    mask = lambda s: deidentify.mask_columns(df, {"t": {"strategy": s, "entity_types": ["SSN"]}}, "job").first()["t"]
    assert mask("pseudonymize") == "PSEUDO_6C87467D7EC0" and mask("generalize") == "***-**-6789"


def test_detection_audit_and_risk(spark):
    df = spark.createDataFrame([(i, f"user{i}@x.example", 7) for i in range(20)], "i int, t string, n int")
    config = {"columns": {}, "auto_detect": True}
    got = deidentify.deidentify(df, config, "job")
    assert got.pii_columns == {"t": ["EMAIL"]} and config == {"columns": {}, "auto_detect": True}
    assert rows(got.audit_log)[0]["masked_values"] == 20 and 0 < got.risk.first()[0] <= 0.5


STAGED = [(1, 10, "x", False), (2, 20, "y", False), (3, 30, "z", False)]


def load(spark, delta, **config):
    staged = spark.createDataFrame(STAGED, "k int, a int, b string, is_deleted boolean")
    rows_ = spark.createDataFrame(delta, "k int, a int, b string, is_deleted boolean, at string, extra int")
    return incremental.load_delta(rows_, staged, {"primary_key": "k", "watermark_column": "at", "cdc_mode": "soft_delete"} | config, "2024-01-01T00:00:00+00:00")


def test_all_paths_of_a_load(spark):
    delta = [(1, None, "Z", False, "2024-02-01", None), (2, 0, "", True, "2024-02-01", None), (9, 0, "", True, "2024-02-01", None), (4, 40, "w", False, "2024-02-02", 5), (4, 41, "v", False, "2024-02-03", 6), (3, 99, "late", False, "2023-12-31", None), (3, 98, "bad", False, "no date", None)]
    got = load(spark, delta)
    table = {r["k"]: (r["a"], r["b"], r["extra"]) for r in rows(got.dataframe)}
    assert table == {1: (10, "Z", None), 3: (30, "z", None), 4: (41, "v", 6)}
    assert (got.inserted_rows, got.updated_rows, got.deleted_rows) == (1, 1, 2)
    assert got.watermark.startswith("2024-02-03T00:00:00")
    assert {r["k"]: r["a"] for r in rows(load(spark, delta, overwrite_nulls=True).dataframe)}[1] is None


def test_empty_delta_and_sequences(spark):
    got = load(spark, [(1, 1, "q", False, "2020-01-01", None)])
    assert got.inserted_rows == 0 and got.dataframe.count() == 3 and got.watermark == "2024-01-01T00:00:00+00:00"
    df = spark.createDataFrame([("5",), ("x",), ("12",)], "s string")
    assert [r["s"] for r in incremental.delta(df, "s", "7", "sequence").collect()] == ["12"]
    assert incremental.delta(df, "absent", None) is df


def test_gate_results(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, None, 3), (2, "b", 4)], "id int, s string, n int")
    check = lambda name, **k: {"expectation_type": name, "kwargs": k}
    suite = [
        (check("expect_column_values_to_be_unique", column="id"), False), (check("expect_column_values_to_be_unique", column="s"), True),
        (check("expect_column_values_to_not_be_null", column="s", mostly=0.6), True), (check("expect_column_values_to_be_null", column="s"), False),
        (check("expect_column_pair_values_A_to_be_greater_than_B", column_A="n", column_B="id"), True), (check("expect_compound_columns_to_be_unique", column_list=["id", "s"]), True),
        (check("expect_table_columns_to_match_set", column_set=["id", "s", "n"]), True), (check("expect_column_value_lengths_to_be_between", column="s", max_value=1), True),
        (check("expect_column_sum_to_be_between", column="n", min_value=10, max_value=10), True), (check("expect_column_median_to_be_between", column="n", min_value=3), True),
        (check("expect_something_else"), False), (check("expect_column_max_to_be_between", column="gone"), False), (check("expect_column_min_to_be_between", wrong=1), False),
    ]
    got = gate.validate(df, {"expectations": [s for s, _ in suite]})
    assert [r["success"] for r in got.results] == [w for _, w in suite] and got.quality_score == round(8 / 13, 4) and not got.passed
    assert gate.validate(df.limit(0)).passed is False or gate.validate(df.limit(0)).quality_score < 1
    assert gate.load_suite(spark, "/no/such/file.json") == {}


def test_monitor_edges(spark):
    df = spark.createDataFrame([("a", "2024-01-02"), (" ", "x"), (None, "2023-01-01")], "s string, t string")
    one = lambda d, c=None: df.agg(monitor.metric(df, d, c, "2024-01-02 12:00:00")).first()[0]
    assert one("accuracy", "s") == pytest.approx(1 / 3) and one("timeliness", "t") == pytest.approx(1 / 3) and one("other") == 0.0
    none = df.limit(0)
    assert none.agg(monitor.metric(none, "completeness", "s")).first()[0] == 0.0
    empty = monitor.run_rules(df, [])
    assert empty.passed and empty.quality_score == 0.0
    got = monitor.run_rules(df, [{"column": "s", "threshold": 0.9}, {"column": "s", "threshold": 0.9, "alert_on_failure": False}])
    assert len(got.violations) == 2 and len(got.alerts) == 1


def test_anomalies_need_five_points(spark):
    h = spark.createDataFrame([("k", i, 1.0 + (i % 2) * 0.01) for i in range(6)] + [("k", 6, 9.0)] + [("c", i, 1.0) for i in range(6)], "key string, seq int, value double")
    got = {(r["key"], r["seq"]): r for r in rows(monitor.anomalies(h))}
    assert got["k", 6]["is_anomaly"] and got["k", 3]["z_score"] is None and not any(got["c", i]["is_anomaly"] for i in range(6))
    assert rows(monitor.recent(h, 2), "key", "seq")[-1]["seq"] == 6


def test_lineage_diamond_cycle_and_fields(spark):
    edge = lambda i, o, f=None: lineage.record(spark, "s", i, o, f, tenant_id="t")
    e = edge(["A"], "B", {"x": ["a", "b"], "y": ["c"]}).unionByName(edge(["A"], "C")).unionByName(edge(["B", "C"], "D", {"z": ["x"]})).unionByName(edge(["D"], "A"))
    assert {(r["uri"], r["depth"]) for r in rows(lineage.upstream(e, "D", "t"))} == {("B", 1), ("C", 1), ("A", 2)}
    assert {r["uri"] for r in rows(lineage.downstream(e, "A"))} == {"B", "C", "D"}
    assert {(r["uri"], r["field"]) for r in rows(lineage.trace_field(e, "D", "z")) if r["uri"] == "A"} == {("A", "a"), ("A", "b")}
    assert {r["uri"]: r["fields"] for r in rows(lineage.impact(e, "A"))}["B"] == ["x", "y"]
    assert lineage.upstream(e, "D", "other").count() == 0 and lineage.run_events(e).count() == 4
    assert set(lineage.dataset_lineage(e, "D")) == {"upstream", "downstream", "graph"}
