"""Language sources: imports of subtitles and transcripts, aligned once for each content and index.

An import's key is the hash of its file, offset, language and of the index it is aligned
with. Stored imports are a memo by that key: only requests whose key is not stored are
aligned, and a source without any is not even read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import identity, intervals

#: What a cue of an import must have, and what it may have.
NEEDED, OPTIONAL = ("source_id", "id", "pos", "begin", "end", "text"), {"translation": "string", "language": "string", "speaker": "string", "confidence": "double"}


def keyed(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """``requests`` (source_id, id, sha256, offset, language) with ``key``, that of the memo."""
    keys = identity.cache_key(requests, identity.index_fingerprint(frames))
    return requests.join(keys, ["source_id", "id"])


def remember(requests: DataFrame, cues: DataFrame, frames: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all cues of the requests, the new ones among them): stored cues where the key is known, aligned ones else.

    ``requests``: source_id, id, sha256, offset, language. ``cues``: their cues by source_id
    and id (of the request), with the columns of ``NEEDED`` and any of ``OPTIONAL``. ``stored``:
    cues as this gives them. Equal requests are one import. Out: the columns of an aligned cue
    (``intervals.align_store``) with key and, in the first table, ``cache_reused``.
    """
    wanted = staged(keyed(requests, frames), "requests")
    have = stored.select("source_id", "key").distinct()
    missing = staged(wanted.join(have, ["source_id", "key"], "left_anti").groupBy("source_id", "key").agg(F.min("id").alias("id"), F.first("offset").alias("offset"), F.first("language").alias("said")), "missing")
    extra = [(F.col(c) if c in cues.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()]
    fresh = cues.select(*NEEDED, *extra).join(missing, ["source_id", "id"]).withColumn("language", F.coalesce("language", "said")).drop("id", "said")
    near = frames.join(missing.select("source_id").distinct(), "source_id", "left_semi")
    columns = ["source_id", "key", "pos", "id", "original_start", "original_end", "start_time", "end_time", "text_original", *OPTIONAL, "frame_ranges", "alignment", "warnings"]
    made = staged(intervals.align_store(fresh, near).select(*columns), "aligned")
    old = stored.join(wanted.select("source_id", "key").distinct(), ["source_id", "key"], "left_semi").select(*columns)
    return old.withColumn("cache_reused", F.lit(True)).unionByName(made.withColumn("cache_reused", F.lit(False))), made
