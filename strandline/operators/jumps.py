"""Greedy starts over one long source, in blocks.

The fold: a row begins a new stretch if it is marked, if its time is at least ``span`` above
that of the row that began the stretch, or, where its own time is unknown, if its ordinal is
at least ``ordinals`` above. What matters of all rows before is only the row that began the
open stretch, and from it the two thresholds that end the stretch.

So each row has one next start, whoever began the stretch it is in: the first later row that
passes its thresholds or is marked. Inside a block all next starts are found at once (maxima
over powers of two), and following them by doubling gives for each row the start that is
open when the block ends. A block is then a small table: which thresholds enter it at which
row, and which start leaves it. Only these tables are walked in order, one row for each
block; knowing the start that enters it, each block is finished on its own. One source
without any gap is as many tasks as it has blocks.

Only rows that thresholds can enter at are in a block's table: unmarked rows whose time is
above all times of the block before them, up to the first that is ``span`` above all times
before the block, rows of unknown time up to ``ordinals`` behind the block's first, and the
first marked row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have the package

#: Ordinals of a block.
BLOCK = 1 << 16
#: Rows of finished blocks that are worked on at once.
CHUNK = 1 << 18
NONE, MARKED, SPAN, ORDINALS = 0, 1, 2, 3


def first_above(values: np.ndarray, start: np.ndarray, least: np.ndarray, reach: int) -> np.ndarray:
    """For each i the first j of start[i] .. start[i] + ``reach`` - 1 with values[j] >= least[i], else one beyond."""
    n, levels, size = len(values), [values], 1
    while 2 * size <= min(reach, n):
        levels.append(np.maximum(levels[-1][: n - 2 * size + 1], levels[-1][size : n - size + 1]))
        size *= 2
    at = start.copy()
    for level in reversed(levels):  # skips as much as has no such j, by powers of two
        fits = np.flatnonzero(at + size <= n)
        low = fits[level[at[fits]] < least[fits]]
        at[low] += size
        size //= 2
    return at


def thresholds(time: np.ndarray, span: float, rule: str) -> np.ndarray:
    """The least time that ends a stretch begun at ``time``; infinite where that is unknown.

    ``sum``: t >= time + span. ``difference``: t - time >= span, whose least t may differ in the
    last bit and is searched for.
    """
    total = time + span
    if rule == "difference":
        unit = 4 * np.spacing(np.maximum(np.abs(np.nan_to_num(time)), span))
        lo, hi = total - unit, total + unit
        for _ in range(48):
            mid = lo + (hi - lo) / 2
            ends = mid - time >= span
            lo, hi = np.where(ends, lo, mid), np.where(ends, mid, hi)
        total = hi
    return np.where(np.isnan(time), np.inf, total)


@dataclass(frozen=True)
class Rule:
    """What ends a stretch besides marks."""

    span: float
    ordinals: int | None
    kind: str

    def next_starts(self, frame: np.ndarray, time: np.ndarray, marked: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
        """The next start of each row if it began a stretch; at or beyond ``end[i]`` (of its group) if there is none."""
        n = len(frame)
        after, known = np.arange(1, n + 1), ~np.isnan(time)
        nxt = end.copy()
        if marked.any():
            nxt = np.minimum(nxt, first_above(marked.astype(np.int8), after, np.ones(n, dtype=np.int8), reach))
        if known.any():
            nxt = np.minimum(nxt, first_above(np.where(known, time, -np.inf), after, thresholds(time, self.span, self.kind), reach))
        if self.ordinals is not None and not known.all():
            nxt = np.minimum(nxt, first_above(np.where(known, np.iinfo(np.int64).min, frame), after, frame + self.ordinals, reach))
        return nxt

    def enters(self, frame: np.ndarray, time: np.ndarray, marked: np.ndarray, in_frame: int, in_time: float) -> int:
        """The first row that ends the stretch begun at ``in_frame``; the number of rows if there is none."""
        ends = marked | (time >= thresholds(np.array([in_time]), self.span, self.kind)[0])
        if self.ordinals is not None:
            ends |= np.isnan(time) & (frame >= in_frame + self.ordinals)
        return int(ends.argmax()) if ends.any() else len(frame)


def _doublings(nxt: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Where 1, 2, 4, ... starts later is, as long as any row has such a start."""
    levels = [nxt]
    while True:
        inside = np.flatnonzero(levels[-1] < end)
        if not len(inside):
            return levels[:-1]
        far = levels[-1].copy()
        far[inside] = levels[-1][levels[-1][inside]]
        levels.append(far)


def _last(levels: list[np.ndarray], end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The start that is open when the group ends, for a stretch begun at each of ``at``."""
    at = at.copy()
    for level in reversed(levels):
        to = level[at]
        at = np.where(to < end[at], to, at)
    return at


def path(nxt: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All starts that follow from the ``first`` ones, these included."""
    at = first
    for level in reversed(_doublings(nxt, end)):
        to = level[at]
        at = np.concatenate([at, to[to < end[at]]])
    return at


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted batches, many at a time, with where each begins."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in keys:
            code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            at = cut(table)
            if len(at) > 1:  # the last group may go on
                yield table.slice(0, int(at[-1])), at[:-1]
            held = table.slice(int(at[-1])).combine_chunks().to_batches()
            n = sum(b.num_rows for b in held)
            # a group beyond the size is looked at again only when it has doubled
            n = n if n < CHUNK else CHUNK - n
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in names]


_ENTRY = "__of {source}, __at_block long, pos long, kind int, bound double, out_frame long, out_time double"


def _entries(rows: DataFrame, blocks: DataFrame, rule: Rule) -> DataFrame:
    """The tables of all blocks: rows that thresholds can enter at, and the start that leaves then."""
    held = rows.join(blocks, [F.col("__source").eqNullSafe(F.col("__s")), F.col("__block") == F.col("__b")]).select("__source", "__block", "__frame", "__time", "__marked", "__above", "__later")
    schema = _ENTRY.format(source=rows.schema["__source"].dataType.simpleString())

    def run(batches):
        for table, first in _groups(batches, ["__source", "__block"]):
            frame, time, marked, above, later = _columns(table, "__frame", "__time", "__marked", "__above", "__later")
            time, marked = time.astype(np.float64), marked.astype(bool)
            marked[first] |= ~later[first].astype(bool)
            sizes = np.diff(np.append(first, len(frame)))
            end = np.repeat(first + sizes, sizes)
            levels = _doublings(rule.next_starts(frame, time, marked, end, int(sizes.max())), end)
            out = []
            for lo, n in zip(first.tolist(), sizes.tolist(), strict=True):
                f, t, m = frame[lo : lo + n], time[lo : lo + n], marked[lo : lo + n]
                stop = int(m.argmax()) if m.any() else n
                record = t > np.maximum.accumulate(np.append(-np.inf, np.where(np.isnan(t[:-1]), -np.inf, t[:-1])))
                limit = thresholds(np.array([above[lo]], dtype=np.float64), rule.span, rule.kind)[0]
                at = np.flatnonzero(record[:stop])
                picks = [(at[: int(np.searchsorted(t[at], limit)) + 1] if limit < np.inf else at[:0], SPAN)]
                if rule.ordinals is not None:
                    at = np.flatnonzero(np.isnan(t[:stop]))
                    picks.append((at[: int(np.searchsorted(f[at], f[0] - 1 + rule.ordinals)) + 1], ORDINALS))
                picks.append((np.arange(stop, min(stop + 1, n)), MARKED))
                for at, kind in picks:
                    last = _last(levels, end, lo + at)
                    bound = t[at] if kind == SPAN else f[at].astype(np.float64)
                    out.append((np.full(len(at), lo), at, np.full(len(at), kind, dtype=np.int32), bound, frame[last], time[last]))
            whose, pos, kind, bound, out_frame, out_time = (np.concatenate(x) for x in zip(*out, strict=True))
            whose = pa.array(whose)
            yield from pa.table([table.column("__source").take(whose), table.column("__block").take(whose), pa.array(pos), pa.array(kind), pa.array(bound), pa.array(out_frame), pa.array(out_time)], schema.replace(",", "").split()[::2]).combine_chunks().to_batches()

    return held.repartition("__source", "__block").sortWithinPartitions("__source", "__block", "__frame").mapInArrow(run, schema)


def _walk(entries: DataFrame, blocks: DataFrame, rule: Rule) -> DataFrame:
    """(__of, __at_block, in_frame, in_time): the start that is open when a block begins. One row of a
    block's table after the other, in one sorted scan for each source; blocks that cannot be
    entered come as one row of kind ``NONE``."""
    schema = f"__of {entries.schema['__of'].dataType.simpleString()}, __at_block long, in_frame long, in_time double"
    all_blocks = blocks.select(F.col("__s").alias("__of"), F.col("__b").alias("__at_block"), F.lit(-1).cast("long").alias("pos"), F.lit(NONE).alias("kind"), F.lit(0.0).alias("bound"), F.lit(0).cast("long").alias("out_frame"), F.lit(0.0).alias("out_time"))

    def run(batches):
        source, state = object(), None
        for batch in batches:
            out = []
            for of, block, _, kind, bound, frame, time in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == NONE:  # the head of a block
                    if of != source:
                        source, state = of, None
                    if state is not None:
                        out.append((of, block, *state))
                    entered = False
                    begun = state
                elif not entered:
                    if kind == MARKED:
                        entered = True
                    elif kind == SPAN:
                        entered = begun is not None and bound >= thresholds(np.array([np.nan if begun[1] is None else begun[1]]), rule.span, rule.kind)[0]
                    else:
                        entered = begun is not None and bound >= begun[0] + rule.ordinals
                    if entered:
                        state = (frame, None if time is None or np.isnan(time) else time)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field(0).type if i == 0 else [None, pa.int64(), pa.int64(), pa.float64()][i]) for i in range(4)], ["__of", "__at_block", "in_frame", "in_time"])

    return entries.unionByName(all_blocks).repartition("__of").sortWithinPartitions("__of", "__at_block", "pos").mapInArrow(run, schema)


def starts(rows: DataFrame, source: str, ordinal: str, time: str, span: float, marked: str | None = None, ordinals: int | None = None, kind: str = "difference") -> DataFrame:
    """``rows`` with ``start`` (ordinal of the row that began its stretch) and ``why`` (``NONE`` for
    rows that began none, else ``MARKED``, also for a source's first row, ``SPAN`` or ``ORDINALS``).

    Ordinals differ within a source; a null or NaN time is unknown. ``marked`` is a boolean
    column. ``kind`` says how times are compared: their ``difference`` with ``span``, or with the ``sum``.
    """
    rule, own = Rule(span, ordinals, kind), [c for c in rows.columns if c not in ("start", "why")]
    flag = F.coalesce(F.col(marked), F.lit(False)) if marked else F.lit(False)
    at = F.col(time).cast("double")
    private = {"__source": F.col(source), "__block": F.floor(F.col(ordinal) / BLOCK), "__frame": F.col(ordinal).cast("long"), "__time": F.when(~F.isnan(at), at), "__marked": flag}
    rows = staged(rows.select(*own).withColumns(private), "rows")
    known = rows.groupBy(F.col("__source").alias("__s"), F.col("__block").alias("__b")).agg(F.max("__time").alias("__top"))
    before = W.partitionBy("__s").orderBy("__b")
    blocks = known.select("__s", "__b", F.max("__top").over(before.rowsBetween(W.unboundedPreceding, -1)).alias("__above"), (F.row_number().over(before) > 1).alias("__later"))
    if blocks.where("__later").isEmpty():  # every source is one block: nothing enters
        dealt = rows.withColumns({"in_frame": F.lit(None).cast("long"), "in_time": F.lit(None).cast("double")})
    else:
        entering = _walk(_entries(rows, blocks, rule), blocks, rule)
        dealt = rows.join(entering, [F.col("__source").eqNullSafe(F.col("__of")), F.col("__block") == F.col("__at_block")], "left").drop("__of", "__at_block")
    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("start", T.LongType()), T.StructField("why", T.IntegerType())])

    def run(batches):
        for table, first in _groups(batches, ["__source", "__block"]):
            frame, time, marked, in_frame, in_time = _columns(table, "__frame", "__time", "__marked", "in_frame", "in_time")
            time, marked = time.astype(np.float64), marked.astype(bool)
            sizes = np.diff(np.append(first, len(frame)))
            end = np.repeat(first + sizes, sizes)
            opened = np.isnan(in_frame.astype(np.float64))[first]
            marked[first[opened]] = True
            nxt = rule.next_starts(frame, time, marked, end, int(sizes.max()))
            begin = first.copy()
            for g in np.flatnonzero(~opened).tolist():
                lo, n = int(first[g]), int(sizes[g])
                begin[g] = lo + rule.enters(frame[lo : lo + n], time[lo : lo + n], marked[lo : lo + n], int(in_frame[lo]), float(in_time[lo]))
            begun = path(nxt, end, begin[begin < first + sizes])
            why = np.zeros(len(frame), dtype=np.int32)
            why[begun] = np.where(marked[begun], MARKED, np.where(np.isnan(time[begun]), ORDINALS, SPAN))
            last = np.maximum.accumulate(np.where(why > 0, np.arange(len(frame)), -1))
            outside = last < np.repeat(first, sizes)
            start = frame[np.maximum(last, 0)]
            if outside.any():
                start[outside] = in_frame[outside].astype(np.int64)
            for batch in pa.table([*(table.column(c) for c in own), pa.array(start), pa.array(why)], schema.fieldNames()).combine_chunks().to_batches():
                yield batch

    return dealt.repartition("__source", "__block").sortWithinPartitions("__source", "__block", "__frame").mapInArrow(run, schema)
