"""Joins of points and intervals, and of intervals, on cells whose size follows each interval.

An interval lives on the level of its length: cells of 4**k, the least power of four that
is not below the length, so it lies in at most two of them (three where rounding cuts).
A point lies in one cell of each level that some interval lives on. So a point and an
interval that contains it meet in exactly one cell: no pair comes twice, no cell size has
to be chosen, and an interval of 1e8 s is two rows like any other. Rows that move: at most
three for an interval, one for a point and level in use (levels: powers of four between the
shortest and the longest length, typically a handful).

``fine`` halves the cells so many times: an interval is up to 2**fine + 2 rows then, and the
points inside one long interval are dealt to as many tasks. Cells of whole numbers are never
smaller than one, so a short interval is as many rows as it has ordinals. Hot cells beyond that
are split by adaptive execution as in any join.

Both sides are shuffled and merged, never broadcast: Spark guesses the size of a table from its files and
knows nothing of the rows that cells make of it, so the driver would hold millions of them.

Bounds may be any numbers; integers beyond 2**53 lose low bits, which only widens cells.
Null and NaN match nothing, infinite bounds are open ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lowest level: intervals shorter than 2**LOWEST share cells of that size.
LOWEST = -20
_LARGEST = "double('1.7e308')"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _finite(rows: DataFrame, *columns: str) -> list[str]:
    """SQL of the columns as numbers whose cells can be counted: infinities become large numbers."""
    whole = {f.name for f in rows.schema.fields if f.dataType.simpleString() in WHOLE}
    return [f"`{c}`" if c in whole else f"least(greatest(double(`{c}`), -{_LARGEST}), {_LARGEST})" for c in columns]


def _whole(rows: DataFrame, *columns: str) -> bool:
    return all(rows.schema[c].dataType.simpleString() in WHOLE for c in columns)


def _level(lo: str, hi: str, fine: int, whole: bool = False) -> str:
    """The exponent of the cells' size: length and level are known where lo <= hi."""
    length = f"least(double({hi}) - double({lo}), {_LARGEST})"
    level = f"(greatest({LOWEST}, int(2 * ceil(log2(greatest({length}, pow(2d, {LOWEST}))) / 2))) - {fine})"
    return f"greatest(0, {level})" if whole else level


def _cell(x: str, level: str) -> str:
    return f"floor({x} / pow(2d, {level}))"


def _home(kind: int, lo: str, hi: str, fine: int, whole: bool = False) -> str:
    """The cells of an interval; ``kind`` (0 or 1) tells two joins apart that are done as one."""
    level = _level(lo, hi, fine, whole)
    return f"transform(sequence({_cell(lo, level)}, {_cell(hi, level)}), c -> struct({level} * 2 + {kind} as __of, c as __cell))"


def _on(kind: int, x: str, levels: str) -> str:
    """The cell of a point on each level."""
    return f"transform({levels}, v -> struct(v * 2 + {kind} as __of, {_cell(x, 'v')} as __cell))"


def _dealt(rows: DataFrame, cells: str) -> DataFrame:
    """A row for each cell, which is two columns of the join's key."""
    return rows.withColumn("__c", F.explode(F.expr(cells))).withColumns({"__of": F.col("__c.__of"), "__cell": F.col("__c.__cell")}).drop("__c", "__l")


def _proper(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with lo <= hi; NaN, which is above all numbers, can only be hi."""
    return rows.where(f"`{lo}` <= `{hi}` and not isnan(double(`{hi}`))")


def _levels(rows: DataFrame, lo: str, hi: str, fine: int) -> Column:
    """The levels that intervals live on, one array of at most some hundred."""
    return rows.agg(F.expr(f"collect_set({_level(*_finite(rows, lo, hi), fine, _whole(rows, lo, hi))})")).scalar()


def containing(intervals: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, fine: int = 0) -> DataFrame:
    """Pairs of rows with equal ``keys`` and lo <= at <= hi, each once; other names must differ."""
    spans, points = _proper(intervals, lo, hi), _proper(points, at, at)
    levels = _levels(spans, lo, hi, fine)
    spans = _dealt(spans, _home(0, *_finite(spans, lo, hi), fine, _whole(spans, lo, hi)))
    placed = _dealt(points.withColumn("__l", levels), _on(0, *_finite(points, at), "__l"))
    return spans.hint("merge").join(placed, [*keys, "__of", "__cell"]).where(f"`{at}` between `{lo}` and `{hi}`").drop("__of", "__cell")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], fine: int = 0) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed intervals ``a`` (left) and ``b`` (right) meet, each once.

    Either the left begins inside the right, or the right begins inside the left and later
    than it: two joins of points and intervals, done as one.
    """
    left, right = _proper(left, *a), _proper(right, *b)
    own, other = _levels(left, *a, fine), _levels(right, *b, fine)
    (la, ha), (lb, hb) = _finite(left, *a), _finite(right, *b)
    asked = _dealt(left.withColumn("__l", other), f"concat({_home(1, la, ha, fine, _whole(left, *a))}, {_on(0, la, '__l')})")
    dealt = _dealt(right.withColumn("__l", own), f"concat({_home(0, lb, hb, fine, _whole(right, *b))}, {_on(1, lb, '__l')})")
    first, second = f"`{a[0]}` between `{b[0]}` and `{b[1]}`", f"`{b[0]}` > `{a[0]}` and `{b[0]}` <= `{a[1]}`"
    return asked.hint("merge").join(dealt, [*keys, "__of", "__cell"]).where(f"case when __of % 2 = 0 then {first} else {second} end").drop("__of", "__cell")
