"""Everything reachable in a graph of datasets, however long its chains: interval labels.

Every node takes one of its edges as its tree edge, which makes a forest (rings are
cut where their smallest node is).  Walking round each tree numbers the nodes so that
all below a node have the numbers of one interval.  The walk is not walked: it is a
list of arcs, each with the arc after it.  Tasks follow the arcs as far as they stay in
one block of numbers, and what leads from block to block is ranked by doubling, in as
many rounds as its length has binary digits.  What is reachable over tree edges is
then a range of numbers, whatever the depth; the other edges lead from a number to an
interval, and only as many rounds are needed as such edges must be taken one after
the other.  An index is written once and answers any number of questions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import settled
from .sample import with_row_id

#: Numbers that share a join key where links are looked up in intervals.
SHELF = 4_096
#: Neighbouring numbers among which one task follows pointers; even, so that both arcs of a node are in one.
BLOCK = 1 << 18


def followed(pointers: DataFrame, fold: str) -> tuple[DataFrame, DataFrame]:
    """``at, next, value`` of pointers followed inside their blocks, and of those where a block is entered, followed to the end.

    Numbers have one pointer at most; one that leads below 0 or to a number without
    a pointer ends there.  Values on the way are folded by ``sum`` or ``min``.  What
    still leads somewhere among the second rows is on a ring or leads to one.
    """
    size, add, none = BLOCK, {"sum": np.add, "min": np.minimum}[fold], {"sum": 0, "min": (1 << 63) - 1}[fold]

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        base = int(block["at"].iloc[0]) // size * size
        own = block["at"].to_numpy() - base
        following, value = np.full(size, -1, np.int64), np.full(size, none, np.int64)
        following[own], value[own] = block["next"].to_numpy(), block["value"].to_numpy()
        for _ in range(size.bit_length()):
            inside = np.flatnonzero((following >= base) & (following < base + size))
            if not len(inside):
                break
            to = following[inside] - base
            value[inside], following[inside] = add(value[inside], value[to]), following[to]
        return pd.DataFrame({"at": own + base, "next": following[own], "value": value[own]})

    near = settled(pointers.groupBy(F.floor(F.col("at") / size)).applyInPandas(walk, "at bigint, next bigint, value bigint"))
    entered = near.filter("next >= 0").select(F.col("next").alias("at")).distinct()
    ways = settled(near.join(entered, "at", "left_semi"))
    more = F.coalesce("more", F.lit(none))
    folded = F.col("value") + more if fold == "sum" else F.least("value", more)
    for _ in range(ways.count().bit_length()):
        going = ways.filter("next >= 0")
        if going.isEmpty():
            break
        over = ways.select(F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("value").alias("more"))
        further = going.join(over, "next", "left").select("at", F.coalesce("beyond", F.lit(-1)).alias("next"), folded.alias("value"))
        ways = settled(ways.filter("next < 0").unionByName(further))
    return near, ways


def tree_edges(edges: DataFrame) -> DataFrame:
    """``node, parent`` for each node with an edge into it, rings cut open: one edge ``parent -> node`` at most."""
    chosen = settled(edges.filter("source <> target").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent")))
    near, ways = followed(chosen.select(F.col("node").alias("at"), F.col("parent").alias("next"), F.least("node", "parent").alias("value")), "min")
    # A pointer is on a ring, or leads to one, if it still leads somewhere: inside its block, or after all rounds.
    ring = near.filter((F.col("next") >= 0) & (F.floor(F.col("next") / BLOCK) == F.floor(F.col("at") / BLOCK))).unionByName(ways.filter("next >= 0"))
    return chosen.join(ring.select(F.col("value").alias("node")).distinct(), "node", "left_anti")


def numbered(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, low, high``: all nodes below a node, and itself, have ``low`` from its own up to its ``high``."""
    above = nodes.join(tree, "node", "left").select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("parent").isNull().alias("root"))
    # Children of a node stand beside each other, and so do the roots, which nothing is above.
    placed = settled(with_row_id(above, ["root", "parent", "node"], "place"))
    children = placed.filter("NOT root").groupBy(F.col("parent").alias("node")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    row, whole = placed.join(children, "node", "left"), 2 * placed.count()
    over = row.select(F.col("node").alias("parent"), F.col("place").alias("above"), F.col("last").alias("end"))
    # A node has the arc down to it, twice its place, and the one up from it after that.
    down = 2 * F.col("place")
    up, beside = down + 1, down + 2
    after = F.when(F.col("root"), F.when(beside < whole, beside).otherwise(-1)).when(F.col("place") < F.col("end"), beside).otherwise(2 * F.col("above") + 1)
    arcs = row.join(over, "parent", "left").select(F.explode(F.array(F.struct(down.alias("at"), F.coalesce(2 * F.col("first"), up).alias("next")), F.struct(up.alias("at"), after.alias("next")))).alias("a"))
    # How many arcs are still to come.
    near, ways = followed(arcs.select("a.at", "a.next", F.when(F.col("a.next") < 0, 0).otherwise(1).cast("bigint").alias("value")), "sum")
    ranked = near.join(ways.select(F.col("at").alias("next"), F.col("value").alias("more")), "next", "left")
    position = F.lit(whole) - F.col("value") - F.coalesce("more", F.lit(0))
    is_up = F.col("at") % 2 == 1
    ends = ranked.groupBy(F.floor(F.col("at") / 2).alias("place")).agg(F.max(F.when(~is_up, position)).alias("low"), F.max(F.when(is_up, position)).alias("high"))
    return placed.select("place", "node").join(ends, "place").select("node", "low", "high")


@dataclass
class ReachIndex:
    """``labels(node, low, high)`` and ``links(at, low, high)``: edges outside the forest, from a number to an interval."""

    labels: DataFrame
    links: DataFrame

    @classmethod
    def build(cls, edges: DataFrame) -> ReachIndex:
        """Of ``source, target`` texts; null ends are no edges."""
        edges = settled(edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
        names = settled(with_row_id(edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct(), ["name"], "node"))
        edges = edges.join(names.select(F.col("name").alias("source"), F.col("node").alias("a")), "source").join(names.select(F.col("name").alias("target"), F.col("node").alias("b")), "target")
        edges = settled(edges.select(F.col("a").alias("source"), F.col("b").alias("target")))
        tree = settled(tree_edges(edges))
        spans = settled(numbered(tree, names.select("node")))
        labels = settled(names.join(spans, "node").select(F.col("name").alias("node"), "low", "high"))
        rest = edges.join(tree.select(F.col("parent").alias("source"), F.col("node").alias("target")), ["source", "target"], "left_anti")
        at = spans.select(F.col("node").alias("source"), F.col("low").alias("at"))
        links = rest.join(at, "source").join(spans.withColumnRenamed("node", "target"), "target").select("at", "low", "high")
        # A link to where the tree leads anyway says nothing new.
        inside = links.join(spans.select(F.col("low").alias("at"), F.col("high").alias("end")), "at").filter("NOT (low >= at AND high <= end)")
        return cls(labels, settled(inside.select("at", "low", "high")))

    def write(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        self.links.write.mode("overwrite").parquet(f"{path}/links")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ReachIndex:
        return cls(spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/links"))

    def reach(self, node: str) -> DataFrame:
        """``uri``: all nodes that can be reached from ``node`` by one edge or more, itself left out."""
        seen = front = self.labels.filter(F.col("node") == node).select("low", "high")
        places = self.links.select("at").distinct()
        while True:
            hit = self.links.join(_inside(places, "at", front), "at", "left_semi").select("low", "high")
            # Only outermost intervals are kept: inside them nothing new can be found, and together they are no longer than the walk.
            wider = settled(_outermost(seen.unionByName(hit)))
            front = wider.join(seen, ["low", "high"], "left_anti")
            if front.isEmpty():
                break
            seen = wider
        return _inside(self.labels, "low", seen).select(F.col("node").alias("uri")).filter(F.col("uri") != node)


def _shelf(number: str) -> Column:
    return F.floor(F.col(number) / SHELF)


def _outermost(spans: DataFrame) -> DataFrame:
    """Those of ``spans`` that lie in no other one, each once; they are nested or apart."""
    rows = spans.select("low", "high").distinct().withColumn("shelf", _shelf("low"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One that starts earlier and ends later holds it; what starts on earlier shelves comes from one row a shelf.
    tops = rows.groupBy("shelf").agg(F.max("high").alias("top")).select("shelf", F.max("top").over(before.orderBy("shelf")).alias("earlier"))
    beside = rows.withColumn("beside", F.max("high").over(before.partitionBy("shelf").orderBy("low")))
    return beside.join(tops, "shelf").filter("coalesce(greatest(beside, earlier), -1) < high").select("low", "high")


def _inside(points: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """Those of ``points`` whose number ``at`` lies in one of ``spans``, which are apart.

    Numbers and spans stand in order on each shelf, so a number looks at the last
    span before it alone and nothing is paired.
    """
    pieces = spans.select(F.explode(F.sequence(_shelf("low"), _shelf("high"))).alias("shelf"), F.col("low").alias("place"), F.col("high").alias("end"))
    both = points.select(_shelf(at).alias("shelf"), F.col(at).alias("place"), F.struct(*points.columns).alias("row")).unionByName(pieces, allowMissingColumns=True)
    last = F.last("end", ignorenulls=True).over(Window.partitionBy("shelf").orderBy("place", F.col("row").isNotNull()))
    return both.withColumn("end", last).filter("row IS NOT NULL AND end >= place").select("row.*")
