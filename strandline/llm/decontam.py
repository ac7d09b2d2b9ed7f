"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup,
exact weighted-shingle verification.

A document is compared with an item of n words through its windows of n words, or as a
whole if it has fewer. The similarity is the weighted Jaccard of their ``shingle``-word shingles, the weight being
the number of occurrences; words are runs of letters and digits, ASCII case folded.

1. A window of full size needs 8/9 of its shingles in common with the item to reach 0.8
   (a shorter text 4/9 of both counts together), so windows with fewer shingles that
   occur in any item of that size cannot match and get no fingerprint.
2. The others get a 64-bit SimHash. Items are indexed by size and by ``RADIUS + 1``
   blocks of their fingerprint: two fingerprints within the radius agree on at least one
   block, so the lookup returns all items of that size within the radius.
3. Candidates are verified exactly; the best window of each document and item is kept.

The items are handled in blocks of at most ``ITEMS`` rows and ``CHARS`` characters, which
bounds what is broadcast; each block is one pass over the documents.

Defined results: null texts match nothing; items with fewer words than a shingle are not
searched, since chance cannot be told from copying; repeated rows each give their row; of
windows with the best similarity the first is given. Texts and items of any length are
searched whole; empty tables of either kind give no leak. Only ids and texts are read, so
other columns do not matter; null ids are carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import prepare
from .wordhash import PUNCTUATION, U, Words, ragged

RADIUS, BITS = 20, 64
ITEMS, CHARS = 20_000, 32 << 20
_TABLE_BITS = 22


def _words(texts: list[bytes]) -> Words:
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    return Words(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), np.cumsum(lens + 1) - lens - 1, fold_case=True, between=PUNCTUATION)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of shingle hashes; a shingle counts as often as it occurs."""
    out = np.zeros(len(shingles), dtype=np.uint64)
    need = shingles.shape[1] / 2
    for bit in range(BITS):
        ones = ((shingles >> U(bit)) & U(1)).sum(axis=1)
        out |= (ones >= need).astype(np.uint64) << U(bit)
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags."""
    inter = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return inter / (sum(a.values()) + sum(b.values()) - inter)


class Index:
    """Fingerprints of one block of items."""

    def __init__(self, ids: list, texts: list[str], shingle: int = 5, threshold: float = 0.8):
        self.shingle, self.threshold = shingle, threshold
        self.ids, self.bags, self.prints = [], [], []
        self.blocks: dict[tuple[int, int, int], list[int]] = {}
        edges = np.linspace(0, BITS, RADIUS + 2).astype(int)
        self.cuts = [(int(a), (1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        w = _words([t.encode() for t in texts])
        found = []
        for i, n in enumerate(w.n_words):
            if n < shingle:
                continue
            h = w.windows(shingle, np.arange(w.first[i], w.first[i] + n - shingle + 1))
            found.append(h)
            k = len(self.ids)
            self.ids.append(ids[i])
            self.bags.append(Counter(h.tolist()))
            self.prints.append(int(simhash(h[None, :])[0]))
            for b, value in enumerate(self._values(self.prints[k])):
                self.blocks.setdefault((int(n), b, value), []).append(k)
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat([len(f) + shingle - 1 for f in found], [len(f) for f in found]) if found else np.zeros(0, np.int64)
        pairs = np.unique(np.rec.fromarrays([every, owner], names="h,n"))
        self.known, self.size_at, self.size_n = np.unique(pairs["h"], return_index=True, return_counts=True)
        self.size_of = pairs["n"]  # the sizes of the items that have known shingle i: size_at[i] and on
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.known >> U(BITS - _TABLE_BITS)).astype(np.int64)] = True

    def _values(self, fingerprint: int) -> list[int]:
        return [(fingerprint >> at) & mask for at, mask in self.cuts]

    def within_radius(self, size: int, fingerprint: int) -> list[int]:
        near = {k for b, v in enumerate(self._values(fingerprint)) for k in self.blocks.get((size, b, v), ())}
        return [k for k in sorted(near) if (self.prints[k] ^ fingerprint).bit_count() <= RADIUS]

    def search(self, texts: list[bytes]) -> list[tuple[int, object, int, int, float]]:
        """(text, item id, first word, words, similarity) of the best window per text and item."""
        if not len(self.known):
            return []
        w = _words(texts)
        at = np.flatnonzero(w.left() >= self.shingle)
        h = w.windows(self.shingle, at)
        may = np.flatnonzero(self.table[(h >> U(BITS - _TABLE_BITS)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.known, h[may]), len(self.known) - 1)
        hit = self.known[i] == h[may]
        may, i = may[hit], i[hit]
        texts_hit = np.unique(w.text_of[at[may]])
        out = []
        for t in texts_hit:
            lo = np.searchsorted(at, w.first[t])
            hi = np.searchsorted(at, w.first[t + 1])
            own = slice(np.searchsorted(may, lo), np.searchsorted(may, hi))
            out += [(int(t), *row) for row in self._in_text(h[lo:hi], may[own] - lo, i[own])]
        return out

    def _in_text(self, h: np.ndarray, place: np.ndarray, known: np.ndarray) -> list[tuple[object, int, int, float]]:
        best: dict[int, tuple[float, int, int]] = {}
        share = self.threshold / (1 + self.threshold)
        n = self.size_n[known]
        sizes, place = self.size_of[ragged(self.size_at[known], n)], np.repeat(place, n)
        for size in np.unique(sizes).tolist():
            m = size - self.shingle + 1
            own = place[sizes == size]
            width = min(m, len(h))  # a text shorter than the item is its own window
            least = max(share * (m + width), self.threshold * m) - 1e-9
            if len(own) < least:
                continue
            hits = np.zeros(len(h) + 1, dtype=np.int64)
            hits[own + 1] = 1
            hits = np.cumsum(hits)
            starts = np.flatnonzero(hits[width:] - hits[:-width] >= least)
            for part in np.array_split(starts, max(1, len(starts) * width >> 20)):
                windows = h[part[:, None] + np.arange(width)]
                for s, row, fp in zip(part.tolist(), windows, simhash(windows).tolist(), strict=True):
                    near = self.within_radius(size, fp)
                    bag = Counter(row.tolist()) if near else None
                    for k in near:
                        score = similarity(bag, self.bags[k])
                        if score >= self.threshold and score > best.get(k, (0.0,))[0]:
                            best[k] = (score, s, width + self.shingle - 1)
        return [(self.ids[k], s, n, score) for k, (score, s, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, shingle: int, threshold: float) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        if ids and (len(ids) >= ITEMS or size + len(row[1]) > CHARS):
            yield Index(ids, texts, shingle, threshold)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if ids:
        yield Index(ids, texts, shingle, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of every leaked item."""
    spark = docs.sparkSession
    prepare(spark)
    id_type, item_type = docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    out = spark.createDataFrame([], schema)
    for index in item_blocks(benchmark, item_id, item_text, shingle, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                rows = shared.value.search([r or b"" for r in batch.column(1).to_pylist()])
                cols = [pa.array(c) for c in list(zip(*rows, strict=True))[1:]] if rows else [[]] * 4
                kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), *(pa.array(c, k) if isinstance(c, list) else c.cast(k) for c, k in zip(cols, kinds, strict=True))], schema.fieldNames())

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents in which no item was found; one pass for each block of items."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text)
    for index in item_blocks(benchmark, item_id, item_text, shingle, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [(t or "").encode() for t in batch.column(at).to_pylist()]
                keep = np.ones(len(raw), dtype=bool)
                keep[[r[0] for r in shared.value.search(raw)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_benchmark_decontamination(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_leaks(docs, items)
    return found.withColumn("similarity", F.round("similarity", 6))
