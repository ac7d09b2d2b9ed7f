"""Exact substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words of one document. Every word covered by a window
whose word sequence also starts anywhere else in the corpus (the same document included)
is removed; windows are judged on the input.

Method. D is a difference cover modulo P: for any two positions i, j some shift d < P
brings both i + d and j + d into D. Anchors of ``window - P + 1`` words are hashed only
at positions in D (5 of 21). Any repeated window holds an anchor at an aligned position
in both places, so windows without an anchor that occurs twice need not be looked at.
The windows around shared anchors are then extended to the full ``window`` words and
compared by a 96-bit hash of the word sequence.

Defined results: null text counts as no words; texts shorter than a window lose nothing;
repeated rows are two documents and so repeat each other; null ids are carried along.
Overlapping windows remove their words once. Texts of any length are read whole; an empty
table gives an empty one. Columns of the documents named like a result give way to it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import Scratch
from .wordhash import Words

PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
RESULT_SCHEMA = "digest binary, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _anchors(block: tb.Block, window: int):
    """Per piece: (first text, raw, offsets, words, indices of anchors); and all anchor hashes."""
    size = window - PERIOD + 1
    out, hashes, copied = [], [], []
    for first, raw, starts in block.pieces():
        w = Words(np.frombuffer(raw, np.uint8), starts)
        at = np.flatnonzero(_IN_COVER[w.pos % PERIOD] & (w.left() >= size) & (w.n_words[w.text_of] >= window))
        out.append((first, raw, starts, w, at))
        hashes.append(w.windows(size, at) & np.uint64(0xFFFFFFFFFFFF0000))  # what a request carries
        copied.append(block.copies[first + w.text_of[at]] > 1)
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    return out, np.concatenate(hashes or empty[0]), np.concatenate(copied or empty[1])


def _candidates(block: tb.Block, window: int, parts: int, batch: pa.RecordBatch, row: int):
    """Windows that hold a shared anchor: per piece their word indices; then hashes of all."""
    pieces, hashes, copied = _anchors(block, window)
    keys, _, _, inverse = tb.distinct_keys(hashes, copied)
    flag = tb.read_bits(batch, row, 0, parts, keys)[inverse] if len(keys) else np.zeros(0, bool)
    done, a, b, again, taken = [], [], [], [], 0
    for first, raw, starts, w, at in pieces:
        shared = np.zeros(w.n + PERIOD + 1, dtype=np.int64)
        shared[at[flag[taken : taken + len(at)]] + 1] = 1
        taken += len(at)
        total = np.cumsum(shared)
        near = total[PERIOD : PERIOD + w.n] - total[: w.n] > 0
        s = np.flatnonzero(near & (w.left() >= window))
        done.append((first, raw, starts, w, s))
        a.append(w.windows(window, s))
        b.append((w.windows(window, s, second=True) >> np.uint64(32)).astype(np.uint32))
        again.append(block.copies[first + w.text_of[s]] > 1)
    none = np.zeros(0)
    join = lambda x, kind: np.concatenate(x) if x else none.astype(kind)
    return done, join(a, np.uint64), join(b, np.uint32), join(again, bool)


def dedup_texts(docs: DataFrame, text: str = "text", window: int = 35, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct text: its md5, word counts, removed word ranges and kept text."""
    if window < PERIOD + 2:
        raise ValueError(f"window must be at least {PERIOD + 2} words")
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    corpus = tb.build_corpus(scratch, docs, text)
    parts = corpus.parts

    def ask_anchors(batches):
        for block, _, _ in tb.read_blocks(batches):
            _, hashes, copied = _anchors(block, window)
            keys, _, multi, _ = tb.distinct_keys(hashes, copied)
            yield tb.request_batch(0, block.id, parts, keys, None, multi)

    def ask_windows(batches):
        for block, batch, row in tb.read_blocks(batches):
            _, a, b, again = _candidates(block, window, parts, batch, row)
            keys, extra, multi, _ = tb.distinct_keys(a, again, b)
            yield tb.request_batch(1, block.id, parts, keys, extra, multi, width=8)

    def remove(batches):
        for block, batch, row in tb.read_blocks(batches):
            pieces, a, b, again = _candidates(block, window, parts, batch, row)
            keys, _, _, inverse = tb.distinct_keys(a, again, b)
            flag = tb.read_bits(batch, row, 1, parts, keys)[inverse] if len(keys) else np.zeros(0, bool)
            taken = 0
            for first, raw, starts, w, s in pieces:
                hit = s[flag[taken : taken + len(s)]]
                taken += len(s)
                change = np.zeros(w.n + 1, dtype=np.int32)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + window, -1)
                yield _result(block, first, raw, starts, w, np.cumsum(change[:-1]) > 0)

    first = scratch.table(tb.answers(corpus.blocks.mapInArrow(ask_anchors, tb.REQUEST_SCHEMA)), "anchors")
    second = scratch.table(tb.answers(tb.with_answers(corpus, first).mapInArrow(ask_windows, tb.REQUEST_SCHEMA), width=8, extra=True), "windows")
    return tb.with_answers(corpus, first, second).mapInArrow(remove, RESULT_SCHEMA)


def _result(block: tb.Block, first: int, raw: bytes, starts: np.ndarray, w: Words, gone: np.ndarray) -> pa.RecordBatch:
    digests, n_words, n_removed, spans, kept = [], [], [], [], []
    for t, start in enumerate(starts):
        k = first + t
        lo, hi = w.first[t], w.first[t + 1]
        words = raw[start : start + int(block.lens[k])].split()
        out = gone[lo:hi]
        n = int(out.sum())
        edge = np.flatnonzero(np.diff(out.view(np.int8), prepend=np.int8(0), append=np.int8(0))) if n else []
        digests.append(block.digests[k])
        n_words.append(int(hi - lo))
        n_removed.append(n)
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        kept.append((b" ".join(compress(words, ~out)) if n else b" ".join(words)).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
        ["digest", "n_words", "n_removed", "removed", "kept_text"],
    )


def per_document(docs: DataFrame, results: DataFrame, text: str = "text") -> DataFrame:
    """Every document with the row of its text; columns of ``docs`` named like a result give way to it."""
    docs = docs.drop(*(c for c in results.columns if c not in ("digest", text)))
    keyed = docs.withColumn("__digest", tb.text_key(text))
    return keyed.join(results.withColumnRenamed("digest", "__key"), F.col("__digest") == F.col("__key"), "left").drop("__digest", "__key")


def op6_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_texts(docs).select("digest", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    empty = F.sha2(F.lit(""), 256)
    return per_document(docs, found).select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", empty).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH w AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS seq
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(seq)) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM dup
), words AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r
"""
