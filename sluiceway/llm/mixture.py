"""Mixing sources to target weights by distributed prefix sums.

Each row gets a hash-random key.  Keys are range-sorted inside their source and
a row's place is the number of units before it, so every source can be cut at
its exact budget; a budget above the source's size starts a second epoch.

The prefix sums are hierarchical and never put a whole source in one task: keys
are uniform, so equal key ranges ("cells") of a source hold about
``CELL_ROWS`` rows whatever the corpus.  Rows are summed inside a cell, cells
inside a block of ``FAN`` cells, blocks inside their source.  Only the per-source
totals (one row a source) are looked at globally.

Budgets are found by water-filling: with caps ``c_i`` (``max_epochs`` times a
source's size) and weights ``w_i`` the level ``l`` solves
``sum(min(c_i, l * w_i)) = total``, which is what resharing every excess by
weight converges to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 128
FAN = 256
#: The key has 60 bits: 15 hexadecimal digits of an MD5.
_KEY_SPAN = float(1 << 60)


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII blanks; null counts 0."""
    one_blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(one_blank, " "), lambda w: w != "")).cast("long")


def hash_key(row_id: Column, salt: str = "mix", content: Column | None = None) -> Column:
    """Hash-random key of a row, the same in every run; with a digest of its ``content``, rows that share an id get keys of their own."""
    parts = [F.lit(salt + ":"), F.coalesce(row_id.cast("string"), F.lit(""))]
    if content is not None:
        parts += [F.lit(":"), F.coalesce(content.cast("string"), F.lit(""))]
    digits = F.substring(F.md5(F.concat(*parts)), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def budgets(totals: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """``totals`` (source, source_size, source_rows) with the weight and target of each source.

    Sources take the weights in turn, in code point order, null last.  One row a
    source: a catalogue, so one task orders it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    cat = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cat = cat.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    cat = cat.withColumn("asked", F.sum("source_size").over(everything).cast("double") * share)
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    cat = cat.withColumn("level", (F.col("asked") - before) / after)
    # The first source that its share of the rest doesn't overfill has the level; later ones only have less.
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    cat = cat.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))))
    return cat.select("source", "source_size", "source_rows", "target")


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    content: Column | None = None,
) -> DataFrame:
    """How many units of each row the mixture takes: id, source, size, source_size, target, taken.

    ``taken`` is at most ``max_epochs * size``; the row at which a budget ends
    gives only the units still missing, so each source's sum is its target
    rounded to a whole unit.  Null sources form one source that sorts last; null
    or negative sizes count 0; sources of size 0 get target 0; rows that repeat
    an id share its key and are ordered by size, but for those that ``content`` (a
    digest) tells apart.  Other columns aren't read.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        F.col(source_col).cast("string").alias("source"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        hash_key(F.col(id_col), content=content).alias("key"),
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = budgets(totals, list(weights), share, max_epochs).withColumn("cells", F.ceil(F.col("source_rows") / CELL_ROWS))
    plan = plan.withColumnRenamed("source", "plan_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    rows = rows.withColumn("cell", F.floor(F.col("key") / _KEY_SPAN * F.col("cells")).cast("long"))

    # Sums of cells, of blocks of cells, and what stands before each.
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")).withColumn("block", F.floor(F.col("cell") / FAN))
    prior = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("source", "block").agg(F.sum("cell_size").alias("block_size"))
    blocks = blocks.select("source", "block", F.coalesce(F.sum("block_size").over(prior("source", "block")), F.lit(0)).alias("before_block"))
    cells = cells.withColumn("in_block", F.coalesce(F.sum("cell_size").over(prior("source", "block", "cell")), F.lit(0)))
    c, b = cells.alias("c"), blocks.alias("b")
    starts = c.join(b, F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.block") == F.col("b.block"))).select(
        F.col("c.source").alias("at_source"), F.col("c.cell").alias("at_cell"), (F.col("in_block") + F.col("before_block")).alias("before_cell")
    )
    inside = Window.partitionBy("source", "cell").orderBy("key", "row_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("cell") == F.col("at_cell")))

    budget = F.floor(F.col("target") + 0.5).cast("long")
    place = F.col("in_cell") + F.col("before_cell")
    taken = sum(
        (F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * epoch - place)) for epoch in range(max_epochs)),
        F.lit(0),
    )
    return rows.select(F.col("row_id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
