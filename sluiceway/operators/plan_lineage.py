"""Which input fields each output field comes from, read off the analysed plan.

Every attribute of a Spark plan has an expression id.  From the leaves up, an
attribute that a node passes on keeps its id; one that a node makes (an alias, an
aggregate, a window, a generator, a union's column) depends on the attributes that
its expression mentions; a node whose work Spark can't see into (a Python function
over rows) makes all its columns of all it gets.  Following ids down to the leaves
gives the fields of the tables that were read.  Conditions of filters and joins
choose rows and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Field:
    """A column of something that a plan reads; ``source`` names files, a table or what else it is."""

    source: str
    name: str


def _seq(items: Any) -> list:
    return [items.apply(i) for i in range(items.size())]


def _id(attribute: Any) -> tuple:
    made = attribute.exprId()
    return made.id(), str(made.jvmId())


def _source(leaf: Any) -> str:
    kind = leaf.getClass().getSimpleName()
    if kind == "LogicalRelation":
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            return ",".join(str(p) for p in _seq(relation.location().rootPaths().toIndexedSeq()))
        return relation.getClass().getSimpleName()
    return kind


def _unaliased(plan: Any) -> Any:
    return plan.child() if plan.getClass().getSimpleName() in ("SubqueryAlias", "View") and _same_ids(plan) else plan


def _same_ids(plan: Any) -> bool:
    return [_id(a) for a in _seq(plan.output())] == [_id(a) for a in _seq(plan.child().output())]


class _Fields:
    """Fields by attribute, and by the parts of attributes that were made as structs."""

    def __init__(self) -> None:
        self.of: dict[tuple, frozenset[Field]] = {}
        self.parts: dict[tuple, list[frozenset[Field]]] = {}

    def expression(self, e: Any) -> frozenset[Field]:
        kind = e.getClass().getSimpleName()
        if kind in ("AttributeReference", "OuterReference"):
            return self.of.get(_id(e), frozenset())
        if kind == "GetStructField" and e.child().getClass().getSimpleName() == "AttributeReference" and (parts := self.parts.get(_id(e.child()))):
            return parts[e.ordinal()]
        inner: list[frozenset[Field]] = [self.expression(c) for c in _seq(e.children())]
        if kind.endswith("Subquery") or kind == "Exists":
            self.visit(e.plan())
            inner += [self.of[_id(a)] for a in _seq(e.plan().output())]
        return frozenset().union(*inner)

    def alias(self, at: tuple, child: Any) -> None:
        """Enter what an alias makes; a struct's parts also one by one."""
        self.of[at] = self.expression(child)
        if child.getClass().getSimpleName() == "CreateNamedStruct":
            self.parts[at] = [self.expression(v) for v in _seq(child.valExprs())]
        elif child.getClass().getSimpleName() == "AttributeReference" and _id(child) in self.parts:
            self.parts[at] = self.parts[_id(child)]

    def visit(self, plan: Any) -> None:
        """Enter every attribute of ``plan`` and of all below it."""
        plan = _unaliased(plan)
        children = _seq(plan.children())
        for child in children:
            self.visit(child)
        output = _seq(plan.output())
        if not children:
            for a in output:
                self.of.setdefault(_id(a), frozenset([Field(_source(plan), a.name())]))
            return
        kind = plan.getClass().getSimpleName()
        if kind == "Union":
            # Columns of a union go together by place, also where it keeps its first child's ids.
            for place, a in enumerate(output):
                self.of[_id(a)] = frozenset().union(*[self.of[_id(_seq(child.output())[place])] for child in children])
            return
        if kind == "Expand":
            # Each projection gives a row of its own; a column comes from what stands in its place in any of them.
            rows = [_seq(p) for p in _seq(plan.projections())]
            for place, a in enumerate(output):
                self.of[_id(a)] = frozenset().union(*[self.expression(r[place]) for r in rows])
            return
        below = {_id(a) for child in children for a in _seq(child.output())}
        missing = [a for a in output if _id(a) not in below]
        if not missing:
            return
        expressions = _seq(plan.expressions().toIndexedSeq())
        made = {_id(e): e.child() for e in expressions if e.getClass().getSimpleName() == "Alias"}
        for a in missing:
            if (child := made.get(_id(a))) is not None:
                self.alias(_id(a), child)
            elif expressions and not any(w in kind for w in ("Python", "Arrow", "Pandas", "MapElements", "MapPartitions")):
                self.of[_id(a)] = frozenset().union(*[self.expression(e) for e in expressions])
            else:
                self.of[_id(a)] = frozenset().union(*[self.of[i] for i in below])


def field_sources(df: DataFrame) -> dict[str, list[Field]]:
    """The fields that each column of ``df`` comes from; columns made of constants have none."""
    plan = df._jdf.queryExecution().analyzed()
    fields = _Fields()
    fields.visit(plan)
    order = lambda f: (f.source, f.name)
    return {a.name(): sorted(fields.of[_id(a)], key=order) for a in _seq(plan.output())}


def field_mappings(df: DataFrame) -> dict[str, list[str]]:
    """As :func:`field_sources`, by names alone: what a lineage edge records."""
    return {name: list(dict.fromkeys(f.name for f in fields)) for name, fields in field_sources(df).items()}
