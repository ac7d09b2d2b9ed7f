"""Distinct texts in blocks, and a request/response protocol over hashed features.

Operators that must know which hashed features (anchors, windows, signatures) occur in
more than one place of the corpus would normally shuffle every feature twice: once to
count it and once, with its position, to bring the verdict back. Here each block of
texts sends only its sorted distinct hashes, range-partitioned by value; the answer is
one bit per hash in the same order. The block recomputes its hashes when it reads the
answer, so no position and no text moves with the features.

* a feature shared by a third of all rows is one entry per block, never one per row;
* exact copies of a text are merged (with map-side combine) before anything else;
* blocks are rows of a table in the shared folder, so re-reading them is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, shuffle_partitions
from .wordhash import ragged

#: A block holds at least one text and about this many bytes; more when the corpus is large.
MIN_BLOCK, MAX_BLOCK, BLOCKS = 4 << 20, 256 << 20, 400
#: Bytes that are compressed together, and that are worked on at once.
PIECE, STEP = 4 << 20, 1 << 20
MAX_TEXTS = 1 << 22
#: Bytes of text for which a part holds the keys, and the least for which a request row stands.
PART, ROW = 64 << 20, 2048
#: Keys that are sorted at once when a part is answered.
SORTED = 1 << 21
BLOCK_SCHEMA = "block long, n_texts int, digests binary, copies binary, lens binary, pieces array<binary>"


@dataclass
class Corpus:
    """Blocks of distinct texts plus the sizes that were measured to cut them."""

    blocks: DataFrame
    n_bytes: int
    parts: int


def cut_parts(n_bytes: int, block_bytes: int, least: int) -> int:
    """Parts of the range of values. A block sends one row to each part, so there are at most
    as many parts as leave ``ROW`` bytes of its text for each: rows grow with the input, not
    with its square. (100 TB: 400,000 blocks, 131,072 parts, 5e10 rows of about 0.6 KB.)"""
    return int(max(1, min(max(least, n_bytes // PART + 1), block_bytes // ROW)))


def text_key(col: str):
    return F.unhex(F.md5(F.col(col).cast("binary")))


def build_corpus(scratch: Scratch, docs: DataFrame, text: str = "text") -> Corpus:
    spark = scratch.spark
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = int(min(MAX_BLOCK, max(MIN_BLOCK, n_bytes // BLOCKS)))
    distinct = docs.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    packed = distinct.select(text_key("text").alias("digest"), "text", "copies").mapInArrow(_packer(size), BLOCK_SCHEMA)
    return Corpus(scratch.table(packed, "blocks"), n_bytes, cut_parts(n_bytes, size, shuffle_partitions(spark)))


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        block = TaskContext.get().partitionId() << 16
        digests, copies, lens, pieces, piece, held, total = [], [], [], [], [], 0, 0

        def close_piece():
            nonlocal piece, held
            if piece:
                pieces.append(squeeze.compress(b"\n".join(piece) + b"\n"))
            piece, held = [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([len(lens)], pa.int32()), pa.array([b"".join(digests)], pa.binary()),
                 pa.array([np.array(copies, "<i8").tobytes()], pa.binary()), pa.array([np.array(lens, "<i8").tobytes()], pa.binary()), pa.array([pieces], pa.list_(pa.binary()))],
                ["block", "n_texts", "digests", "copies", "lens", "pieces"],
            )

        for batch in batches:
            for digest, text, n in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                digests.append(digest.as_py())
                copies.append(n)
                lens.append(len(raw))
                piece.append(raw)
                held += len(raw)
                total += len(raw)
                if held >= PIECE:
                    close_piece()
                if total >= size or len(lens) >= MAX_TEXTS:
                    close_piece()
                    yield row()
                    block += 1
                    digests, copies, lens, pieces, total = [], [], [], [], 0
        if lens:
            close_piece()
            yield row()

    return pack


class Block:
    """One row of the block table."""

    def __init__(self, block: int, digests: bytes, copies: bytes, lens: bytes, pieces: list[bytes]):
        self.id, self.packed = block, pieces
        self.digests = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        self.copies, self.lens = np.frombuffer(copies, "<i8"), np.frombuffer(lens, "<i8")

    def pieces(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(number of the first text, raw bytes, byte offset of each text), about ``STEP`` bytes at a time."""
        import zstandard

        expand, t = zstandard.ZstdDecompressor(), 0
        for p in self.packed:
            raw = expand.decompress(p)
            begin = at = 0
            first, starts = t, []
            while at < len(raw):
                starts.append(at - begin)
                at += int(self.lens[t]) + 1
                t += 1
                if at - begin >= STEP or at >= len(raw):
                    yield first, raw[begin:at], np.array(starts, dtype=np.int64)
                    begin, first, starts = at, t, []


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch, int]]:
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            yield Block(*(cols[n][r].as_py() for n in ("block", "digests", "copies", "lens", "pieces"))), batch, r


# --- requests and answers -------------------------------------------------------------

REQUEST_SCHEMA = "kind int, part int, block long, n int, keys binary, multi binary"
ANSWER_SCHEMA = "kind int, part int, block long, bits binary"


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 64-bit values begins in sorted ``keys``."""
    step = (1 << 64) // parts
    edges = np.array([step * i for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` most significant bytes as byte planes: the leading planes of sorted values compress away."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def distinct_keys(keys: np.ndarray, again: np.ndarray, extra: np.ndarray | None = None):
    """Sorted distinct keys, whether each occurs more than once here, and each input's index.

    ``again`` marks inputs that stand for several copies. ``extra`` holds 32 further bits.
    """
    order = np.argsort(keys, kind="stable") if extra is None else np.lexsort((extra, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    e = None
    if extra is not None:
        e = extra[order]
        new[1:] |= e[1:] != e[:-1]
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    multi = np.diff(np.append(at, len(k))) > 1
    np.logical_or.at(multi, group[again[order]], True)
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = group
    return k[at], (None if e is None else e[at]), multi, inverse


def request_batch(kind: int, block: int, parts: int, keys: np.ndarray, extra: np.ndarray | None, multi: np.ndarray, width: int = 6) -> pa.RecordBatch:
    """One row for each range of values in which this block has keys."""
    bounds = _bounds(keys, parts)
    rows = [(p, bounds[p], bounds[p + 1]) for p in range(parts) if bounds[p + 1] > bounds[p]]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([p for p, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([int(b - a) for _, a, b in rows], pa.int32()),
         pa.array([_planes(keys[a:b], width) + (b"" if extra is None else extra[a:b].astype("<u4").tobytes()) for _, a, b in rows], pa.binary()),
         pa.array([np.packbits(multi[a:b]).tobytes() for _, a, b in rows], pa.binary())],
        ["kind", "part", "block", "n", "keys", "multi"],
    )


def answers(requests: DataFrame, width: int = 6, extra: bool = False) -> DataFrame:
    """One bit per requested key: does it occur more than once in the whole corpus?

    A group is one range of hash values over all blocks; its size is the corpus' keys
    divided by the number of parts, since each block sends a key once. Rows hold sorted keys,
    so a large group is answered in narrower ranges, one after the other.
    """

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        at = np.concatenate([[0], np.cumsum(n)])
        keys = np.concatenate([_unplanes(r[: k * width], k, width) for r, k in zip(pdf["keys"], n, strict=True)])
        multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(pdf["multi"], n, strict=True)]).astype(bool)
        more = np.concatenate([np.frombuffer(r[k * width :], "<u4") for r, k in zip(pdf["keys"], n, strict=True)]) if extra else None
        flag = np.zeros(len(keys), dtype=bool)
        low, turns = int(keys.min()), len(keys) // SORTED + 1
        wide = (int(keys.max()) - low) // turns + 1
        edges = np.array([low + wide * i for i in range(1, turns)], dtype=np.uint64)
        cuts = np.array([[0, *np.searchsorted(keys[a:b], edges), b - a] for a, b in zip(at, at[1:], strict=False)])
        for i in range(turns):
            some = ragged(at[:-1] + cuts[:, i], cuts[:, i + 1] - cuts[:, i])
            _, _, seen, inverse = distinct_keys(keys[some], multi[some], None if more is None else more[some])
            flag[some] = seen[inverse]
        return pd.DataFrame({"kind": pdf["kind"], "part": pdf["part"], "block": pdf["block"], "bits": [np.packbits(flag[at[i] : at[i + 1]]).tobytes() for i in range(len(n))]})

    return requests.groupBy("part").applyInPandas(answer, ANSWER_SCHEMA)


def with_answers(corpus: Corpus, *tables: DataFrame) -> DataFrame:
    """Blocks with the bits sent back to them."""
    all_bits = tables[0]
    for t in tables[1:]:
        all_bits = all_bits.unionByName(t)
    per_block = all_bits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "bits"))).alias("bits"))
    return corpus.blocks.join(per_block.hint("shuffle_hash"), "block", "left")


def read_bits(batch: pa.RecordBatch, row: int, kind: int, parts: int, keys: np.ndarray) -> np.ndarray:
    """The answer for sorted distinct ``keys`` of this block."""
    bounds = _bounds(keys, parts)
    out = np.zeros(len(keys), dtype=bool)
    for b in batch.column(batch.schema.names.index("bits"))[row].as_py() or []:
        if b["kind"] == kind:
            lo, hi = bounds[b["part"]], bounds[b["part"] + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=hi - lo)
    return out
