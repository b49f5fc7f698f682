"""Field lineage read off plans, and what the services record of it."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluiceway.operators import clean, features
from sluiceway.operators.plan_lineage import Field, field_mappings, field_sources
from sluiceway.plans.pipeline import Services

from .conftest import DATA


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "nation"))


def test_fields_through_plans(spark):
    c, n = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "nation"))
    c.createOrReplaceTempView("lineage_customer")
    cases = [
        (c.join(n, c.c_nationkey == n.n_nationkey).filter("c_custkey > 3").select((F.col("c_acctbal") * F.col("n_regionkey")).alias("x"), "c_name", F.lit(1).alias("one")), {"x": ["c_acctbal", "n_regionkey"], "c_name": ["c_name"], "one": []}),
        (c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n")), {"c_nationkey": ["c_nationkey"], "s": ["c_acctbal"], "n": []}),
        (c.select("c_name", F.explode(F.split("c_name", "#")).alias("w")), {"c_name": ["c_name"], "w": ["c_name"]}),
        (c.select(F.col("c_name").alias("a")).union(n.select("n_name")), {"a": ["c_name", "n_name"]}),
        (c.select("c_custkey", "c_name").mapInArrow(lambda part: part, "a long, b string"), {"a": ["c_custkey", "c_name"], "b": ["c_custkey", "c_name"]}),
        (c.alias("a").join(c.alias("b"), "c_custkey").select(F.col("a.c_name").alias("x"), F.col("b.c_acctbal").alias("y")), {"x": ["c_name"], "y": ["c_acctbal"]}),
        (spark.sql("WITH q AS (SELECT c_name AS m FROM lineage_customer) SELECT upper(m) AS u, (SELECT max(c_acctbal) FROM lineage_customer) AS top FROM q"), {"u": ["c_name"], "top": ["c_acctbal"]}),
        (c.select(F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal")).alias("r")), {"r": ["c_acctbal", "c_nationkey"]}),
        (c.select(F.struct("c_name", F.col("c_acctbal").alias("b")).alias("s")).select(F.col("s.b").alias("only")), {"only": ["c_acctbal"]}),
        (spark.createDataFrame([(1, 2)], "a int, b int").selectExpr("a + b AS c"), {"c": ["a", "b"]}),
    ]
    for df, want in cases:
        assert field_mappings(df) == want
    assert field_sources(c.select("c_name"))["c_name"] == [Field(f"file:{DATA}/customer.parquet", "c_name")]


def test_fields_through_cleaning_and_features(spark):
    c = spark.read.parquet(f"{DATA}/customer.parquet")
    tidy = clean.clean(c, {"normalize": ["c_acctbal"], "encoding": {"c_mktsegment": "label"}, "imputation_strategy": "mean"})
    made = features.transform(tidy, {"rename": {"c_name": "name"}, "interactions": [["c_custkey", "c_acctbal"]]})
    assert field_mappings(made) == {"c_custkey": ["c_custkey"], "name": ["c_name"], "c_nationkey": ["c_nationkey"], "c_acctbal": ["c_acctbal"], "c_mktsegment": ["c_mktsegment"], "c_custkey_x_c_acctbal": ["c_acctbal", "c_custkey"]}


def test_the_pipeline_records_real_mappings(spark, tmp_path):
    s = Services(spark, str(tmp_path), "acme")
    first = s.orchestrate({"input_uri": f"{DATA}/customer.parquet", "skip_profile": True, "cleaning": {"drop_cols": ["c_nationkey"]}, "transform": {"rename": {"c_name": "name"}, "interactions": [["c_custkey", "c_acctbal"]]}})
    second = s.orchestrate({"input_uri": first.output_uri, "skip_profile": True, "transform": {"rename": {"name": "label"}}})
    found = s.lineage(second.output_uri, "label")["field"].collect()
    assert {(r["uri"], r["field"], r["depth"]) for r in found} == {(first.output_uri, "name", 1), (f"{DATA}/customer.parquet", "c_name", 2)}
    both = s.lineage(second.output_uri, "c_custkey_x_c_acctbal")["field"].filter("depth = 2").collect()
    assert {r["field"] for r in both} == {"c_custkey", "c_acctbal"}
