"""Even splits of a database table, from an equi-depth histogram that the database makes.

Spark's own splits are equally wide, so where values crowd together one task reads
most rows.  Here the database counts rows in cells of equal width; cells that hold
more than a split should are counted again in cells of their own, until each is small
enough or has one value.  Cells are then put together, in order, to splits of about
equal size.  Each count is one grouped query of at most ``CELLS`` rows, and rows are
told apart by the splits' conditions alone, so nothing is lost or read twice even if
the table grows meanwhile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

#: Cells of one count.
CELLS = 256
#: Cells are divided further while they hold over this share of a split.
FINE = 0.25

Ask = Callable[[str], list]


@dataclass(frozen=True)
class Cell:
    """Rows with ``low <= value < high``."""

    low: float
    high: float
    rows: int


def cells_of(ask: Ask, table: str, column: str, low: float, high: float, rows: int, enough: float, whole: bool) -> list[Cell]:
    """Cells of ``[low, high)`` in order, none over ``enough`` rows unless it has one value."""
    width = (high - low) / CELLS
    if whole:
        width = max(1, math.ceil(width))
    if rows <= enough or width <= 0 or low + width <= low or (whole and high - low <= 1):
        return [Cell(low, high, rows)]
    place = f"FLOOR((CAST({column} AS DOUBLE PRECISION) - {low!r}) / {width!r})"
    inside = f"SELECT {place} AS CELL FROM {table} WHERE {column} >= {low!r} AND {column} < {high!r}"
    counted = ask(f"SELECT CELL, COUNT(*) AS N FROM ({inside}) PLACED GROUP BY CELL")
    out: list[Cell] = []
    for cell, n in sorted((int(r[0]), int(r[1])) for r in counted):
        a, b = low + cell * width, min(high, low + (cell + 1) * width)
        if n > enough and (a, b) != (low, high) and b > a:
            out += cells_of(ask, table, column, a, b, n, enough, whole)
        else:
            out.append(Cell(a, b, n))
    return out


def conditions(ask: Ask, table: str, column: str, splits: int, whole: bool) -> list[str]:
    """SQL conditions, one a split, that every row of ``table`` meets exactly one of.

    ``ask`` runs a query on the database and gives its rows, ``whole`` says that
    the column has whole numbers.  Rows without a value are a split of their own.
    A value that a larger share of the rows has stays together.
    """
    low, high, rows, everything = ask(f"SELECT MIN({column}) AS LOW, MAX({column}) AS HIGH, COUNT({column}) AS N, COUNT(*) AS EVERYTHING FROM {table}")[0]
    rows, nothing = int(rows), [f"{column} IS NULL"] if everything > rows else []
    if not rows:
        return nothing or [f"{column} IS NOT NULL"]
    low, high = (int(low), int(high) + 1) if whole else (float(low), math.nextafter(float(high), math.inf))
    share = rows / max(1, splits)
    cells = cells_of(ask, table, column, low, high, rows, max(1.0, FINE * share), whole)
    cuts, before = [], 0
    for cell in cells:
        # A split ends before the cell that would take it further from its share than it is without.
        if before and before + cell.rows / 2 > (len(cuts) + 1) * share and len(cuts) < splits - 1:
            cuts.append(cell.low)
        before += cell.rows
    ends = [f"{column} >= {a!r} AND {column} < {b!r}" for a, b in zip(cuts, cuts[1:], strict=False)]
    if not cuts:
        return [f"{column} IS NOT NULL", *nothing]
    return [f"{column} < {cuts[0]!r}", *ends, f"{column} >= {cuts[-1]!r}", *nothing]
