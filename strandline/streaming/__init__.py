"""Structured Streaming forms of the ordered operators.

Frames arrive in ordinal order per source; there is no watermark, since late times are
counted, never dropped. State is one row per source and survives in the checkpoint, so a
stopped query resumes after the last committed batch.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import jumps

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def streaming_runs(frames: DataFrame, anchor_seconds: float = 0.0) -> DataFrame:
    """frame_no, exact_start, anchor, late, replayed for each frame; equal to the batch operators.

    A frame at or below the last ordinal is a replay: it is reported, with ``replayed``
    true and ``exact_start`` null, and changes no state; ``adapters.replay_mismatches`` holds such
    rows against what is stored. ``late``: the time is not above the last known one; such frames
    are counted by whoever reads them, never dropped. The state holds the last ordinal, digest,
    run start, next anchor and last time.
    """

    rule = jumps.Rule(anchor_seconds, None, "sum")

    def step(key, batches, state):
        last, digest, start, anchor, time = state.get if state.exists else (-1, None, -1, float("-inf"), float("-inf"))
        rows = pd.concat(list(batches)).sort_values("frame_no", kind="stable")
        n, d, t = rows["frame_no"].to_numpy(np.int64), rows["digest"].to_numpy(object), rows["time_s"].to_numpy(np.float64)
        fresh = (n > last) & np.append(True, n[1:] != n[:-1])
        m, own, times = n[fresh], d[fresh], t[fresh]
        starts, take, late = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool), np.zeros(len(n), dtype=bool)
        if len(m):
            change = own != np.append(np.array([digest], dtype=object), own[:-1])
            change[0] |= start < 0
            begun = np.maximum.accumulate(np.where(change, m, start))
            known = ~np.isnan(times)
            at = np.maximum.accumulate(np.where(known, np.arange(len(m)), -1))
            before = np.append(-1, at[:-1])
            starts[fresh], late[fresh] = begun, known & (times <= np.where(before >= 0, times[before], time))
            first = np.flatnonzero(known & (times >= anchor))
            if anchor_seconds > 0 and len(first):
                end = np.full(len(m), len(m))
                path = jumps.path(rule.next_starts(m, times, np.zeros(len(m), dtype=bool), end, len(m)), end, first[:1])
                take[np.flatnonzero(fresh)[path]] = True
                anchor = float(times[path.max()]) + anchor_seconds
            last, digest, start = int(m[-1]), own[-1], int(begun[-1])
            time = float(times[at[-1]]) if at[-1] >= 0 else time
        state.update((last, digest, start, anchor, time))
        told = pd.Series(starts, dtype="Int64").where(pd.Series(fresh))
        yield pd.DataFrame({"source_id": key[0], "frame_no": n, "exact_start": told, "anchor": take, "late": late, "replayed": ~fresh})

    kind = frames.schema["source_id"].dataType.simpleString()
    return frames.groupBy("source_id").applyInPandasWithState(
        step, f"source_id {kind}, frame_no long, exact_start long, anchor boolean, late boolean, replayed boolean", "last long, digest string, start long, anchor double, time double", "append", GroupStateTimeout.NoTimeout
    )


def budget(index: DataFrame, computed: DataFrame, max_new: int | None = None) -> DataFrame:
    """(source_id, frame_no, status): the frames of each source to compute now, in order.

    With a budget the first ``max_new`` that are not computed; ``status`` is ``paused_budget``
    where some remain after it, else ``complete``.
    """
    if max_new is not None and max_new < 1:
        raise ValueError("max_new must be positive")
    left = index.select("source_id", "frame_no").join(computed.select("source_id", "frame_no"), ["source_id", "frame_no"], "left_anti")
    w = W.partitionBy("source_id")
    rows = left.withColumns({"n": F.row_number().over(w.orderBy("frame_no")), "all": F.count(F.lit(1)).over(w)})
    most = F.lit(max_new) if max_new is not None else F.col("all")
    return rows.where(F.col("n") <= most).select("source_id", "frame_no", F.when(F.col("all") > most, "paused_budget").otherwise("complete").alias("status"))
