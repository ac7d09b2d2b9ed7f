"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts of a batch are cut into pre-tokens with array operations over code points, the
distinct pre-tokens become ragged symbol arrays, and each step applies to every sequence
its lowest-rank pair at all its places at once, until no pair has a rank. What survives
is counted; a text's count is the sum over its pre-tokens and special tokens. Sequences
of more than ``LONG`` symbols (a text without blanks is one) are linked arrays whose ranks
are recomputed only beside a merge, so their cost does not grow with symbols times steps.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; an empty table gives an empty one; other columns are carried along, those named like
a result give way to it. Special strings inside texts count as one token each, as the
tokenizer library does by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare
from .wordhash import hash_segments, ragged

#: Code points that \s matches (the White_Space property); fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: Most code points handled at once; a longer text is a batch of its own.
CHUNK = 1 << 20
#: Symbols beyond which a sequence is merged as a linked array.
LONG = 256
NO_RANK = np.int64(1 << 40)


def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[_WHITE] = _SPACE
    return table


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer JSON file.

    Only the split that such vocabularies use by default is supported: contractions,
    optional blank + letters, numbers or others, and white space.
    """

    def __init__(self, path: str, cache_size: int = 1 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary with the default split")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        vocab = spec["model"]["vocab"]
        self.byte_id = np.array([vocab[c] for c in _byte_chars()], dtype=np.int64)
        left, right, new = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        key = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.merged = key[order], order.astype(np.int64), np.array(new, dtype=np.int64)[order]
        self.merged_by_rank = np.array(new, dtype=np.int64)
        self.classes = _classes()
        self.cache_size = cache_size
        self.known, self.known_n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    # -- pre-tokens --------------------------------------------------------------------

    def split(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens in ``code``; ``first`` are the starts of texts."""
        n = len(code)
        kind = self.classes[code]
        begin = np.zeros(n + 1, dtype=bool)
        begin[first] = True
        begin[n] = True
        run = begin[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # white space before something else: its last character leaves the run, and a blank joins what follows
        last_ws = (kind == _SPACE) & np.append(run[1:], True) & ~begin[1:]
        start |= last_ws
        joins = np.flatnonzero(last_ws & (code == 0x20)) + 1
        start[joins] = False
        # contractions: an apostrophe alone between the end of a token and letters
        quote = np.flatnonzero((code == 0x27) & start & (kind == _OTHER))
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == _LETTER) & ~begin[quote + 1]]
        if len(quote):
            end_of_text = np.append(np.flatnonzero(begin), n)
            room = end_of_text[np.searchsorted(end_of_text, quote, side="right")] - quote
            c1 = code[quote + 1]
            c2 = np.where(room > 2, code[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for which, size in ((one, 2), (two & ~one, 3)):
                q = quote[which]
                start[q + 1] = False
                after = q + size
                inside = (after < n) & ~begin[np.minimum(after, n)]
                a = after[inside]
                start[a[kind[a] == _LETTER]] = True
        return np.flatnonzero(start)

    # -- merging -----------------------------------------------------------------------

    def merge(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Number of symbols left of each sequence when no pair has a rank."""
        out = lens.copy()
        seq = np.repeat(np.arange(len(lens)), lens)
        far = lens > LONG
        if far.any():
            there = np.repeat(far, lens)
            out[far] = self._merge_linked(symbols[there], lens[far])
            symbols, seq = symbols[~there], seq[~there]
        ranks = self._ranks(symbols, seq)
        while len(symbols):
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(ranks, first)
            live = low < NO_RANK
            sizes = np.diff(np.append(first, len(seq)))
            out[seq[first[~live]]] = sizes[~live]
            if not live.all():  # finished sequences leave
                keep = np.repeat(live, sizes)
                symbols, seq, ranks, low, sizes = symbols[keep], seq[keep], ranks[keep], low[live], sizes[live]
                if not len(symbols):
                    break
            lowest = np.repeat(low, sizes)
            hit = ranks == lowest
            at = np.flatnonzero(hit)
            # neighbouring hits overlap (a a a): of each stretch every second one counts, from the left
            stretch = np.cumsum(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.searchsorted(stretch, stretch)
            at = at[place % 2 == 0]
            symbols[at] = self.merged_by_rank[lowest[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, seq = symbols[keep], seq[keep]
            ranks = self._ranks(symbols, seq)
        return out

    def _merge_linked(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """``merge`` for long sequences: step by step the lowest rank of all, at all its places."""
        n = len(symbols)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lens)
        right[ends - 1], left[ends - lens] = -1, -1
        ranks = self._ranks(symbols, np.repeat(np.arange(len(lens)), lens))
        waiting: dict[int, list[np.ndarray]] = {}
        turns: list[int] = []

        def wait(places: np.ndarray) -> None:
            own = ranks[places]
            order = np.argsort(own, kind="stable")
            order = order[: np.searchsorted(own[order], NO_RANK)]
            if not len(order):
                return
            places, own = places[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, some in zip(own[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in waiting:
                    waiting[r].append(some)
                else:
                    waiting[r] = [some]
                    heapq.heappush(turns, r)

        wait(np.arange(n))
        gone = np.zeros(n, dtype=bool)
        while turns:
            r = heapq.heappop(turns)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[ranks[at] == r]  # others were merged away or have a new neighbour since
            if len(at) > 1:  # overlapping places (a a a): every second one of a stretch, from the left
                apart = np.append(True, right[at[:-1]] != at[1:])
                if not apart.all():
                    begin = np.flatnonzero(apart)
                    at = at[(np.arange(len(at)) - begin[np.cumsum(apart) - 1]) % 2 == 0]
            if not len(at):
                continue
            eaten = right[at]
            after = right[eaten]
            symbols[at] = self.merged_by_rank[r]
            right[at] = after
            left[after[after >= 0]] = at[after >= 0]
            gone[eaten] = True
            ranks[eaten] = NO_RANK
            before = left[at]
            near = np.unique(np.concatenate([before[before >= 0], at]))
            follow = right[near]
            key = symbols[near] << 32 | symbols[follow]
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            ranks[near] = np.where((self.pair[i] == key) & (follow >= 0), self.rank[i], NO_RANK)
            wait(near)
        return lens - np.add.reduceat(gone, ends - lens, dtype=np.int64)

    def _ranks(self, symbols: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol."""
        out = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            ok = (self.pair[i] == key) & (seq[1:] == seq[:-1])
            out[:-1][ok] = self.rank[i[ok]]
        return out

    def pre_token_counts(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, given as byte ranges."""
        length = end - start
        h = hash_segments(raw, start)
        keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        counts = np.empty(len(keys), dtype=np.int64)
        i = np.searchsorted(self.known, keys)
        old = np.zeros(len(keys), dtype=bool)
        if len(self.known):
            old = self.known[np.minimum(i, len(self.known) - 1)] == keys
            counts[old] = self.known_n[i[old]]
        new = example[~old]
        if len(new):
            n = length[new]
            counts[~old] = self.merge(self.byte_id[raw[ragged(start[new], n)]], n)
            if len(self.known) + len(new) > self.cache_size:
                self.known, self.known_n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            at = np.searchsorted(self.known, keys[~old])
            self.known, self.known_n = np.insert(self.known, at, keys[~old]), np.insert(self.known_n, at, counts[~old])
        return counts[inverse]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), dtype=np.int64)
        pieces, owner = [], []
        for t, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    total[t] += sum(p.count(s) for p in parts)
                    parts = [q for p in parts for q in p.split(s)]
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(t)
        i = 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + len(pieces[j]) <= CHUNK):
                size += len(pieces[j])
                j += 1
            total += np.bincount(owner[i:j], weights=self._count(pieces[i:j]), minlength=len(texts)).astype(np.int64)
            i = j
        return total

    def _count(self, pieces: list[str]) -> np.ndarray:
        joined = "".join(pieces)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lens = np.array([len(p) for p in pieces])
        first = np.cumsum(lens) - lens
        start = self.split(code, first)
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        if len(raw) == len(code):
            at = start
        else:
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            at = (np.cumsum(width) - width)[start]
        n = self.pre_token_counts(raw, at, np.append(at[1:], len(raw)))
        return np.bincount(np.searchsorted(first, start, side="right") - 1, weights=n, minlength=len(pieces))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_MODELS: dict[str, ByteBpe] = {}


def _model(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; the text column is replaced by them.

    ``vocabulary`` is the path of the tokenizer file on every executor.
    """
    prepare(docs.sparkSession)
    names = {f.name for f in docs.schema.fields}
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n = model.count(texts)
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], schema=pa.schema([*(batch.schema.field(i) for i in kept), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            )

    if clash := names & {"n_bytes", "n_tokens", "over_limit"}:
        docs = docs.drop(*clash)
        return count_tokens(docs, vocabulary, text, limit)
    schema = docs.drop(text).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
