"""Running values over ordered rows, so that one long group is many tasks.

A window over a whole source is one task, however long the source. Here rows are windowed in
blocks of their ordinal; one row per block carries what the blocks before hold, and both
are combined. Only these block rows are windowed per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ordinals of a block.
BLOCK = 1 << 16


def running(rows: DataFrame, by: list[str], ordinal: str, order: list[str], **columns: tuple[str, Column, bool]) -> DataFrame:
    """``rows`` with running values: name=(how, value, inclusive).

    ``how`` is ``max``, ``sum`` (of nothing: 0) or ``last`` (the last value that is not null); without
    ``inclusive`` the row itself does not count. ``order`` is a total order that begins with ``ordinal``,
    a number.
    """
    block = F.floor(F.col(ordinal) / BLOCK).alias("__block")
    values = [value.alias(f"__v_{n}") for n, (_, value, _) in columns.items()]
    rows = rows.select("*", block, *values)
    w = W.partitionBy(*by, "__block").orderBy(*order)
    over_blocks = W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    totals, before, local, whole = [], [], {}, {}
    for n, (how, _, inclusive) in columns.items():
        v, t, p = F.col(f"__v_{n}"), F.col(f"__t_{n}"), F.col(f"__p_{n}")
        here = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        if how == "max":
            totals.append(F.max(v).alias(f"__t_{n}"))
            before.append(F.max(t).over(over_blocks).alias(f"__p_{n}"))
            local[f"__l_{n}"] = F.max(v).over(here)
            whole[n] = F.greatest(p, F.col(f"__l_{n}"))
        elif how == "sum":
            totals.append(F.sum(v).alias(f"__t_{n}"))
            before.append(F.sum(t).over(over_blocks).alias(f"__p_{n}"))
            local[f"__l_{n}"] = F.sum(v).over(here)
            whole[n] = F.coalesce(p, F.lit(0)) + F.coalesce(f"__l_{n}", F.lit(0))
        else:
            totals.append(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__t_{n}"))
            before.append(F.last(t, ignorenulls=True).over(over_blocks).alias(f"__p_{n}"))
            local[f"__l_{n}"] = F.last(v, ignorenulls=True).over(here)
            whole[n] = F.coalesce(f"__l_{n}", p)
    prefix = rows.groupBy(*by, "__block").agg(*totals).select(*by, "__block", *before)
    joined = rows.withColumns(local).join(prefix, [*by, "__block"], "left")
    kept = [c for c in rows.columns if not c.startswith("__v_") and c != "__block" and c not in columns]
    return joined.select(*kept, *(c.alias(n) for n, c in whole.items()))


def following(rows: DataFrame, by: list[str], ordinal: str, **columns: Column) -> DataFrame:
    """``rows`` with name=value of the next row by ``ordinal`` (no two alike in a group); null after the last."""
    back = rows.withColumn("__back", -F.col(ordinal))
    told = running(back, by, "__back", ["__back"], __next=("last", F.struct(*(c.alias(n) for n, c in columns.items())), False))
    return told.select(*(c for c in rows.columns if c not in columns), *(F.col(f"__next.{n}").alias(n) for n in columns))
