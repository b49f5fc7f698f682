"""Lineage graphs as tables: edges in, traces and impact out.

An edge row says that a step made ``output_uri`` from ``input_uris``, and which
input fields each output field came from.  Traversals are breadth-first rounds
of equi-joins; a round only extends what the last one reached.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import settled
from .reach import ReachIndex

EDGES = "edge_id string, step_name string, input_uris array<string>, output_uri string, field_mappings map<string,array<string>>, metadata map<string,string>, job_id string, tenant_id string, recorded_at string"
MAX_DEPTH = 10


def record(spark: SparkSession, step_name: str, input_uris: list[str], output_uri: str, field_mappings: dict[str, list[str]] | None = None, metadata: dict | None = None, job_id: str = "", tenant_id: str = "default") -> DataFrame:
    """One edge row, to be appended to an edge table."""
    row = (uuid.uuid4().hex, step_name, list(input_uris), output_uri, field_mappings or {}, {k: str(v) for k, v in (metadata or {}).items()}, job_id, tenant_id, datetime.now(UTC).isoformat())
    return spark.createDataFrame([row], EDGES)


def pairs(edges: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """``source, target, step_name, edge_id``: one row per input of an edge."""
    mine = edges if tenant_id is None else edges.filter(F.col("tenant_id") == tenant_id)
    return mine.select(F.explode("input_uris").alias("source"), F.col("output_uri").alias("target"), "step_name", "edge_id")


def _reach(start: DataFrame, steps: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """Nodes (``keys``) with the least depth at which rounds over ``steps(f_<key>, t_<key>)`` reach them.

    Each round joins the nodes that the last one found first, so a cycle ends
    once it closes; rounds are written to the shared folder, so plans stay short
    and nothing stays in memory.  They end with an empty one or at ``max_depth``.
    """
    on = [F.col(k) == F.col(f"f_{k}") for k in keys]
    front = start.select(*keys).distinct()
    seen, found = front, start.select(*keys).limit(0).withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = front.join(steps, on).select(*[F.col(f"t_{k}").alias(k) for k in keys]).distinct()
        front = settled(reached.join(seen, keys, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        found = found.unionByName(front.withColumn("depth", F.lit(depth)))
    return found


def upstream(edges: DataFrame, uri: str, tenant_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``uri, depth`` of everything ``uri`` was made from; cycles end where they began."""
    p = pairs(edges, tenant_id).select(F.col("target").alias("f_uri"), F.col("source").alias("t_uri"))
    return _reach(edges.sparkSession.createDataFrame([(uri,)], "uri string"), p, ["uri"], max_depth)


def downstream(edges: DataFrame, uri: str, tenant_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``uri, depth`` of everything made from ``uri``."""
    p = pairs(edges, tenant_id).select(F.col("source").alias("f_uri"), F.col("target").alias("t_uri"))
    return _reach(edges.sparkSession.createDataFrame([(uri,)], "uri string"), p, ["uri"], max_depth)


def reach_index(edges: DataFrame, tenant_id: str | None = None, upwards: bool = False) -> ReachIndex:
    """An index of what each dataset leads to (or, ``upwards``, comes from), for chains of any length."""
    p = pairs(edges, tenant_id)
    return ReachIndex.build(p.select(F.col("target").alias("source"), F.col("source").alias("target")) if upwards else p.select("source", "target"))


def trace_field(edges: DataFrame, uri: str, field: str, tenant_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``uri, field, depth`` of the fields that a field came from; every (dataset, field) is followed."""
    mine = edges if tenant_id is None else edges.filter(F.col("tenant_id") == tenant_id)
    flat = mine.select("output_uri", "input_uris", F.explode("field_mappings").alias("made", "used"))
    steps = flat.select("output_uri", "made", F.explode("input_uris").alias("t_uri"), "used").select(F.col("output_uri").alias("f_uri"), F.col("made").alias("f_field"), "t_uri", F.explode("used").alias("t_field"))
    return _reach(edges.sparkSession.createDataFrame([(uri, field)], "uri string, field string"), steps, ["uri", "field"], max_depth)


def impact(edges: DataFrame, uri: str, tenant_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``uri, depth, fields``: datasets affected by a change of ``uri`` and the fields their steps write."""
    mine = edges if tenant_id is None else edges.filter(F.col("tenant_id") == tenant_id)
    fields = mine.select(F.col("output_uri").alias("uri"), F.explode_outer(F.map_keys("field_mappings")).alias("field")).groupBy("uri").agg(F.sort_array(F.collect_set("field")).alias("fields"))
    return downstream(edges, uri, tenant_id, max_depth).join(fields, "uri", "left")


def dataset_lineage(edges: DataFrame, uri: str, tenant_id: str | None = None, max_depth: int = MAX_DEPTH) -> dict[str, DataFrame]:
    """Upstream, downstream and the edges among them."""
    up, down = upstream(edges, uri, tenant_id, max_depth), downstream(edges, uri, tenant_id, max_depth)
    near = up.select("uri").unionByName(down.select("uri")).unionByName(edges.sparkSession.createDataFrame([(uri,)], "uri string")).distinct()
    p = pairs(edges, tenant_id)
    graph = p.join(near.withColumnRenamed("uri", "source"), "source", "left_semi").join(near.withColumnRenamed("uri", "target"), "target", "left_semi")
    return {"upstream": up, "downstream": down, "graph": graph}


def export_graph(edges: DataFrame, tenant_id: str) -> dict[str, DataFrame]:
    """``nodes(uri)`` and ``edges`` of one tenant."""
    p = pairs(edges, tenant_id)
    return {"nodes": p.select(F.col("source").alias("uri")).unionByName(p.select(F.col("target").alias("uri"))).distinct(), "edges": p}


def run_events(edges: DataFrame, namespace: str = "sluiceway") -> DataFrame:
    """``edge_id, event``: each edge as a COMPLETE run event in JSON."""
    dataset = lambda name: F.struct(F.lit(namespace).alias("namespace"), name.alias("name"))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        F.col("recorded_at").alias("eventTime"),
        F.struct(F.col("edge_id").alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.col("step_name").alias("name")).alias("job"),
        F.transform("input_uris", dataset).alias("inputs"),
        F.array(dataset(F.col("output_uri"))).alias("outputs"),
    )
    return edges.select("edge_id", F.to_json(event).alias("event"))
