"""Service-level rules on tables: metrics, verdicts, history, anomalies, trends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, unused

HISTORY = 100
ANOMALY_Z = 3.0
ANOMALY_POINTS = 5
TIMELY = "24 hours"
DIMENSIONS = ("completeness", "uniqueness", "accuracy", "timeliness", "consistency")


def metric(df: DataFrame, dimension: str, column: str | None = None, as_of: str | None = None) -> Column:
    """The aggregate of a dimension, 0 for an empty table or an unknown dimension.

    ``as_of`` is the moment that timeliness counts its 24 hours back from (now by
    default).  Without a (known) column, completeness and uniqueness are about
    whole rows, accuracy and consistency are 1, timeliness is 0.
    """
    known = column in df.columns if column else False
    rows = F.count("*")
    share = lambda good: F.count_if(good) / rows
    if dimension == "completeness":
        everything = F.lit(True)
        for c in df.columns:
            everything &= col(c).isNotNull()
        value = F.count(col(column)) / rows if known else share(everything)
    elif dimension == "uniqueness":
        value = F.count_distinct(col(column)) / rows if known else F.count_distinct(F.struct(*[F.coalesce(col(c).cast("string"), F.lit("\0null")) for c in df.columns])) / rows
    elif dimension == "accuracy":
        if not known:
            value = F.lit(1.0)
        else:
            text = isinstance(df.schema[column].dataType, T.StringType)
            value = share(F.coalesce(col(column).rlike(r"\S"), F.lit(False)) if text else col(column).isNotNull())
    elif dimension == "timeliness" and known:
        kind = df.schema[column].dataType
        moment = col(column).cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.try_to_timestamp(col(column).cast("string"))
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        value = share(F.coalesce(moment >= now - F.expr(f"interval {TIMELY}"), F.lit(False)))
    elif dimension == "consistency":
        value = F.count(col(column)) / rows if known else F.lit(1.0)
    else:
        value = F.lit(0.0)
    return F.when(rows > 0, value).otherwise(0.0).cast("double")


def verdict(value: Column, operator: str, threshold: float, upper: float = 1.0) -> Column:
    """``gte lte eq gt lt between``; anything else means ``gte``."""
    return {
        "lte": value <= threshold,
        "eq": F.abs(value - threshold) < 1e-9,
        "gt": value > threshold,
        "lt": value < threshold,
        "between": value.between(threshold, upper),
    }.get(operator, value >= threshold)


def evaluate(df: DataFrame, rules: list[dict], as_of: str | None = None) -> DataFrame:
    """``rule, dimension, column, metric, operator, threshold, passed, alert``: all rules over one aggregate."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, dimension string, column string, metric double, operator string, threshold double, passed boolean, alert boolean")
    wide = df.agg(*[metric(df, r.get("dimension", "completeness"), r.get("column"), as_of).alias(f"m{i}") for i, r in enumerate(rules)])
    rows = []
    for i, r in enumerate(rules):
        dimension, operator, threshold = r.get("dimension", "completeness"), r.get("operator", "gte"), float(r.get("threshold", 1.0))
        ok = verdict(F.col(f"m{i}"), operator, threshold, float(r.get("upper_threshold", 1.0)))
        rows.append(
            F.struct(
                F.lit(r.get("name") or f"{dimension}_{r.get('column') or '_row'}").alias("rule"),
                F.lit(dimension).alias("dimension"),
                F.lit(r.get("column")).cast("string").alias("column"),
                F.round(F.col(f"m{i}"), 6).alias("metric"),
                F.lit(operator).alias("operator"),
                F.lit(threshold).alias("threshold"),
                ok.alias("passed"),
                (~ok & F.lit(bool(r.get("alert_on_failure", True)))).alias("alert"),
            )
        )
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass
class Verdict:
    passed: bool
    quality_score: float
    rule_results: list[dict]
    violations: list[dict]
    alerts: list[dict]


def run_rules(df: DataFrame, rules: list[dict], as_of: str | None = None) -> Verdict:
    """Collected results; without rules it passes with score 0."""
    results = [r.asDict() for r in evaluate(df, rules, as_of).collect()]
    bad = [r for r in results if not r["passed"]]
    return Verdict(not bad, round((len(results) - len(bad)) / max(len(results), 1), 4), results, bad, [r for r in bad if r["alert"]])


def metric_key(tenant: str, dimension: str, column: str | None) -> str:
    return f"{tenant}__{dimension}__{column or '_row'}"


HISTORY_ROWS = "tenant_id string, key string, seq bigint, value double"
ALERTS = "tenant_id string, uri string, rule string, dimension string, column string, metric double, operator string, threshold double, at string"


def history_rows(results: list[dict], tenant: str, seq: int) -> list[dict]:
    """The metrics of collected rule results as rows of a history table.

    Rules on the same dimension and column measure the same thing: one row for
    them all, so that a key has one value a check.
    """
    values = {metric_key(tenant, r["dimension"], r["column"]): r["metric"] for r in results}
    return [{"tenant_id": tenant, "key": key, "seq": seq, "value": value} for key, value in values.items()]


def alert_rows(alerts: list[dict], tenant: str, uri: str, at: str) -> list[dict]:
    """Failed rules that alert as rows of an alert table."""
    return [{"tenant_id": tenant, "uri": uri, "at": at} | {n: a[n] for n in ("rule", "dimension", "column", "metric", "operator", "threshold")} for a in alerts]


def recent(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last ``keep`` rows of each key of ``history(key, seq, value)``."""
    place, at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))), unused(history, "place")
    return history.withColumn(at, place).filter(F.col(at) <= keep).drop(at)


def anomalies(history: DataFrame) -> DataFrame:
    """``history(key, seq, value)`` with ``z_score`` against the 99 rows before and ``is_anomaly``.

    Fewer than five points in all, or a baseline without spread, give no score.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(1 - HISTORY, -1)
    n, mean, std = F.count("value").over(before), F.avg("value").over(before), F.stddev_samp("value").over(before)
    z = F.when((n >= ANOMALY_POINTS - 1) & (std >= 1e-10), (F.col("value") - mean) / std)
    return history.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.abs("z_score") > ANOMALY_Z, F.lit(False)))


def trends(history: DataFrame, lookback: int = 30) -> DataFrame:
    """``key, n, latest, mean, std, trend``: last third of the last ``lookback`` rows against the first third."""
    last = recent(history, lookback)
    n = F.count("*").over(Window.partitionBy("key"))
    placed = last.withColumns({"n": n, "place": F.row_number().over(Window.partitionBy("key").orderBy("seq"))})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    early, late = F.when(F.col("place") <= third, F.col("value")), F.when(F.col("place") > F.col("n") - third, F.col("value"))
    stats = placed.filter("n >= 2").groupBy("key").agg(F.max("n").alias("n"), F.max_by("value", "place").alias("latest"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg(early).alias("early"), F.avg(late).alias("late"))
    step = F.col("late") - F.col("early")
    trend = F.when(step > 0.2 * F.col("std"), "improving").when(step < -0.2 * F.col("std"), "degrading").otherwise("stable")
    return stats.select("key", "n", "latest", "mean", "std", trend.alias("trend"))
