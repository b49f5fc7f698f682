"""Rows that are as new as each other: which one stays doesn't hang on the order in which tasks bring them."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from sluiceway import queries
from sluiceway.plans import jobs

from .conftest import rows


def test_newest_records_of_a_table_of_files(spark, tmp_path):
    """The later file is the larger one, so Spark reads it first; its rows are still the later ones."""
    lines = spark.range(60).select(F.col("id").alias("l_orderkey"), F.lit(7).cast("bigint").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    folder = tmp_path / "lineitem.parquet"
    lines.coalesce(1).write.parquet(f"{folder}/part=a")
    more = spark.range(6000).select(F.pmod("id", F.lit(60)).alias("l_orderkey"), F.when(F.col("id") < 60, 6).otherwise(7).cast("bigint").alias("l_linenumber"), (F.col("id") % 50 + 2).cast("double").alias("l_quantity"))
    more.coalesce(1).write.parquet(f"{folder}/part=b")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*/*.parquet'")
    got = queries.QUERIES["dsh_newest_records"](spark, str(tmp_path))
    assert got.columns == ["l_orderkey", "l_linenumber", "l_quantity"]
    mine = sorted(map(tuple, got.collect()))
    assert mine == sorted(con.execute(queries.SQL["dsh_newest_records"]).fetchall()) == [(i, 7, 1.0) for i in range(60)]


def test_ties_go_by_the_other_columns(spark):
    states = spark.range(400).select((F.col("id") % 40).alias("k"), F.lit("now").alias("at"), F.col("id").alias("n"), F.array("id").alias("list"))
    for order in ("n", "-n"):
        mixed = states.repartition(3).sortWithinPartitions(F.expr(order))
        assert [r["n"] for r in rows(jobs.current(mixed, ["k"], "at").orderBy("k"))] == list(range(40))
    assert [r["n"] for r in rows(jobs.current(states, ["k"], "at", [F.desc("n")]).orderBy("k"))] == list(range(360, 400))
