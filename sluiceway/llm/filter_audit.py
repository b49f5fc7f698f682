"""What each of several filters does, alone and after others, by inclusion-exclusion.

A filter's *failure* is a 0/1 flag on a row.  One aggregate adds up, for each set of
filters, the product of their flags: how many rows fail all of them together (the
*joint* counts J).  Everything else follows from these 2^k numbers a part:

* survivors of a set P: the sum over Q within P of (-1)^|Q| J(Q)  (a Moebius sum);
* what a filter removes after the set P: survivors of P less survivors of P and it;
* its unique failures: what it removes after all others; its redundant ones: J of it
  less what it removes;
* its Shapley share: a coalition's Harsanyi dividend is (-1)^(|S|+1) J(S), each member
  gets an equal part of it, so shares over all k! orders are whole numbers.

So k! orders are reported without a second look at the rows.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Most filters: beyond, orders and coalitions are too many to list.
MOST = 7


def coalitions(k: int) -> range:
    return range(1 << k)


def within(mask: int) -> list[int]:
    """All subsets of a set of bits."""
    out, sub = [], mask
    while True:
        out.append(sub)
        if not sub:
            return out
        sub = (sub - 1) & mask


def joint_failures(rows: DataFrame, part: Column, flags: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """One row per part with ``joint_<measure>``: an array of 2^k sums, at place S the rows failing all of S.

    ``flags`` are 0/1 columns, null counts 0; ``measures`` are what is added up
    (1 for a count).  A part that holds most rows folds inside each task first.
    """
    if not 0 < len(flags) <= MOST or any(len(n) != 1 for n in flags):
        raise ValueError(f"1 to {MOST} filters named by one sign each")
    names = [f"_f{i}" for i in range(len(flags))]
    kept = [f"_m{i}" for i in range(len(measures))]
    flat = rows.select(part.alias("part"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in zip(names, flags.values(), strict=True)], *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in zip(kept, measures.values(), strict=True)])
    sums = []
    for m in kept:
        for s in coalitions(len(names)):
            product = F.col(m)
            for i, n in enumerate(names):
                if s >> i & 1:
                    product = product * F.col(n)
            sums.append(F.sum(product).alias(f"{m}_{s}"))
    added = flat.groupBy("part").agg(*sums)
    return added.select("part", *[F.array(*[F.col(f"{m}_{s}") for s in coalitions(len(names))]).alias(f"joint_{name}") for m, name in zip(kept, measures, strict=True)])


def survivors(joint: Column, k: int) -> Column:
    """At place P, what passes every filter of P."""
    return F.array(*[sum(((-1) ** q.bit_count() * joint[q] for q in within(p)), F.lit(0).cast("long")) for p in coalitions(k)])


def exactly(joint: Column, k: int) -> Column:
    """At place T, what fails the filters of T and no other."""
    whole = (1 << k) - 1
    return F.array(*[sum(((-1) ** q.bit_count() * joint[t | q] for q in within(whole & ~t)), F.lit(0).cast("long")) for t in coalitions(k)])


def shares(joint: Column, k: int) -> Column:
    """At place i, filter i's Shapley share times k!: dividends of the coalitions it is in, dealt out evenly."""
    orders = math.factorial(k)
    return F.array(*[sum(((-1) ** (s.bit_count() + 1) * (orders // s.bit_count()) * joint[s] for s in coalitions(k) if s >> i & 1), F.lit(0).cast("long")) for i in range(k)])


def order_report(joint: DataFrame, filters: str, losses: dict[str, str], count: str = "rows") -> DataFrame:
    """A row per part, order of the filters and step, from ``joint_failures``.

    ``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``shapley``, and for each ``losses`` (name -> measure) what of that
    measure is removed at the step.
    """
    k = len(filters)
    held = joint.select(
        "part",
        F.col(f"joint_{count}").alias("j"),
        survivors(F.col(f"joint_{count}"), k).alias("s"),
        shares(F.col(f"joint_{count}"), k).alias("h"),
        *[survivors(F.col(f"joint_{m}"), k).alias(f"s_{name}") for name, m in losses.items()],
    )
    orders = ",".join("".join(p) for p in permutations(filters))
    steps = held.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    # The set of filters applied before the step, and the step's own, as bits.
    at = [F.instr("filter_order", c) for c in filters]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(at)), F.lit(0))
    own = sum((F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(at)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("own", own)
    bit = F.expr("shiftleft(1, own)")
    after = F.col("before").bitwiseOR(bit)
    others = F.lit((1 << k) - 1) - bit
    lost = lambda name: F.get(name, F.col("before")) - F.get(name, after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("s", after).alias("kept"),
        lost("s").alias("removed"),
        (F.get("j", bit) - lost("s")).alias("redundant"),
        (F.get("s", others) - F.get("s", F.lit((1 << k) - 1))).alias("unique_fails"),
        *[lost(f"s_{name}").alias(name) for name in losses],
        F.get("h", F.col("own")).alias("shapley"),
    )


def text_flags(text: Column) -> dict[str, Column]:
    """The four failures that a text shows by itself: few words, few different words, many capitals, odd signs."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(body, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n, signs = F.size(words).cast("long"), F.length(body).cast("long")
    capitals = signs - F.length(F.regexp_replace(body, "[A-Z]", ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n, "C": 100 * capitals > 5 * signs, "D": body.rlike(r"[#$%&*|]")}


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``order_report`` of five filters: those of ``text_flags`` and E, a text that a smaller id has too.

    Null texts count as empty, null parts as the empty string.  A null id is
    neither smaller nor larger than any, so such a row doesn't fail E; rows that
    repeat an id don't fail by each other.  A document labelled twice counts as
    good or toxic if either label says so.  Columns of other names aren't read; an
    empty table gives no rows.  Texts are read once: what the audit needs of them is
    a digest and four flags, written narrow to the shared folder.  The smallest id
    of a text folds inside tasks, and both joins are equi-joins that adaptive
    execution can split for a text that a third of all rows share.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    flags = text_flags(F.col(text_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(body, 256).alias("digest"), *[c.cast("tinyint").alias(n) for n, c in flags.items()])
    narrow = materialise(narrow, "audit-rows")
    first = narrow.filter("row_id IS NOT NULL").groupBy("digest").agg(F.min("row_id").alias("first_id"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("row_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = narrow.join(first, "digest", "left").join(marks, "row_id", "left")
    later = F.coalesce(F.col("row_id") > F.col("first_id"), F.lit(False))
    joint = joint_failures(rows, F.col("part"), {n: F.col(n) for n in flags} | {"E": later}, {"rows": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")})
    return order_report(joint, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
