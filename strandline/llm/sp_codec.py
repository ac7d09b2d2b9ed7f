"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format only, no protobuf library): pieces with
scores and types, the model type, byte fallback, and the normaliser. From these the
tokenizers objects are rebuilt: the normaliser with its character map, the metaspace
marker, unigram scores or, for BPE models, the merges that the scores imply, and byte
fallback. Batches are encoded by the library's threads.

``verify=True`` compares every distinct segment (every text, where texts cannot be cut)
with the sentencepiece library itself, and its decoding with the input; where they differ
``parity`` is false, and the ids stay those of the rebuilt tokenizer. Without it ``parity`` is null.

Defined results: null text has null ids and decodes to null; empty text has no ids.
``round_trip`` tells whether decoding gives the text back; it may be false for models
whose normaliser changes text. Texts of any length are encoded whole; repeated rows each;
an empty table gives an empty one. Columns named like a result give way to it.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare
from .wordhash import hash_segments, ragged

MARK = "▁"
# piece types and model types of the model format; fixed values
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
#: Segments joined into one string for the library.
JOINED = 512


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while i < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield tag >> 3, raw[i : i + n]
            i += n
        elif wire == 2:
            n = varint()
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {wire} in a model file")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for n, value in _fields(raw):
            if n == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif n == 2:
                for k, v in _fields(value):
                    if k == 3:
                        m.kind = v
                    elif k == 24:
                        m.suffix = bool(v)
                    elif k == 35:
                        m.byte_fallback = bool(v)
            elif n == 3:
                for k, v in _fields(value):
                    if k == 2:
                        m.charsmap = v
                    elif k == 3:
                        m.dummy_prefix = bool(v)
                    elif k == 4:
                        m.strip_spaces = bool(v)
                    elif k == 5:
                        m.escape = bool(v)
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which the scores apply them."""
        score = {p: s for p, s, k in self.pieces if k == NORMAL}
        rows = []
        for place, (piece, s, kind) in enumerate(self.pieces):
            if kind == NORMAL and len(piece) > 1:
                rows += [(-s, place, cut, (piece[:cut], piece[cut:])) for cut in range(1, len(piece)) if piece[:cut] in score and piece[cut:] in score]
        return [r[3] for r in sorted(rows)]


def build(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.suffix or not m.escape or m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with a metaspace prefix are supported")
    unk = next(i for i, (_, _, k) in enumerate(m.pieces) if k == UNKNOWN)
    if m.kind == UNIGRAM:
        # control pieces are never produced from text
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        model = models.Unigram([(p, s if k in (NORMAL, USER_DEFINED) else low - 1e6 if k != UNKNOWN else s) for p, s, k in m.pieces], unk, m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, m.merges(), unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.strip_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if m.kind == BPE and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in m.pieces if k == NORMAL):
        # no piece crosses the beginning of a word, so words can be merged one by one
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [AddedToken(p, normalized=True, special=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if user:
        t.add_tokens(user)
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


class Codec:
    """Encodes batches through the tokenizers library, each distinct segment once.

    A segment is a run of blanks and what follows it up to the next blank. Where no piece
    crosses the beginning of a segment, the segments of a text can be encoded one by one.
    """

    def __init__(self, path: str, cache_size: int = 3 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            self.raw = f.read()
        self.model = m = Model.parse(self.raw)
        self.tokenizer = build(m)
        self._library = None
        self.identity = not m.charsmap and not m.strip_spaces
        self.by_segment = m.kind == BPE and m.dummy_prefix and not any(k == USER_DEFINED or (k == NORMAL and re.search(f"[^{MARK}]{MARK}", p)) for p, _, k in m.pieces)
        bare = build(m)
        bare.normalizer = None
        self.bare = bare
        shown = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.piece_len = np.array([len(x) for x in shown], dtype=np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.piece_marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.cache_size = cache_size
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, dtype=np.uint64)
        self.at = self.n = np.zeros(0, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    @property
    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return self._library

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text as a whole."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def encode_ragged(self, texts: list[str], verify: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, parity of each)."""
        if not self.by_segment:
            got = self.encode(texts)
            same = np.ones(len(texts), dtype=bool)
            if verify:
                true = self.library.encode(texts, num_threads=1)
                same = np.array([a == b for a, b in zip(got, true, strict=True)], dtype=bool)
            return np.fromiter((i for g in got for i in g), dtype=np.int32), np.array([len(g) for g in got], dtype=np.int64), same
        raw = [t.encode() if self.identity else self.tokenizer.normalizer.normalize_str(t).encode()[len(MARK.encode()) :] for t in texts]
        raw = [b" " + r.replace(MARK.encode(), b" ") if r else b"" for r in raw]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        blank = buf == 0x20
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        first = (np.cumsum(lens) - lens)[lens > 0]
        begin[first] = True
        start = np.flatnonzero(begin)
        keys, example, inverse = np.unique(hash_segments(buf, start), return_index=True, return_inverse=True)
        index = self._lookup(buf, keys, start[example], np.append(start, len(buf))[example + 1], verify)
        index = index[inverse]
        n = self.n[index]
        ids = self.flat[ragged(self.at[index], n)]
        owner = np.repeat(np.arange(len(texts)), lens)[start]
        bad = np.bincount(owner[~self.good[index]], minlength=len(texts)) > 0
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64), ~bad

    def _lookup(self, buf: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray, verify: bool) -> np.ndarray:
        """Places of the distinct segments in the memory, where new ones are added."""
        if len(self.known) + len(keys) > self.cache_size:
            self._forget()
        i = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(i, len(self.known) - 1)] != keys
        if new.any():
            flat, begin, n, good = self._encode_segments([bytes(buf[a:b]).decode() for a, b in zip(start[new], end[new], strict=True)], verify)
            need = self.used + len(flat)
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(need, dtype=np.int32)])
            self.flat[self.used : need] = flat
            at = i[new]
            self.at = np.insert(self.at, at, self.used + begin)
            self.n, self.good = np.insert(self.n, at, n), np.insert(self.good, at, good)
            self.known, self.used = np.insert(self.known, at, keys[new]), need
        return np.searchsorted(self.known, keys)

    def _encode_segments(self, segments: list[str], verify: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, and for each its first id, number of ids and parity) of distinct segments, handed to the library in long strings."""
        n = np.zeros(len(segments), dtype=np.int64)
        begin, good = n.copy(), np.ones(len(segments), dtype=bool)
        flat, used = [], 0
        rest = [i for i, s in enumerate(segments) if len(s) < 2 or s[1] == " "]
        single = [i for i, s in enumerate(segments) if len(s) > 1 and s[1] != " "]
        chunks = [single[i : i + JOINED] for i in range(0, len(single), JOINED)]
        joined = ["".join(segments[i] for i in c) for c in chunks]
        ids = [e.ids for e in self.bare.encode_batch_fast([j.replace(" ", MARK) for j in joined], add_special_tokens=False)]
        if verify:  # the library puts the first blank before the text
            true, back = self.library.encode([j[1:] for j in joined], num_threads=1), self.decode(ids)
        for k, chunk in enumerate(chunks):
            mine = np.array(ids[k], dtype=np.int32)
            first = np.flatnonzero(self.piece_marked[mine])  # the only marked piece of each segment
            if len(first) == len(chunk) and not (verify and (ids[k] != true[k] or back[k] != joined[k][1:])):
                begin[chunk], n[chunk] = used + first, np.diff(np.append(first, len(mine)))
                flat.append(mine)
                used += len(mine)
            else:
                rest += chunk
        for i in rest:
            mine = self.bare.encode(segments[i].replace(" ", MARK), add_special_tokens=False).ids
            if verify and segments[i][1:]:
                right = self.library.encode(segments[i][1:])
                good[i] = mine == right and self.decode([right])[0] == segments[i][1:]
            begin[i], n[i] = used, len(mine)
            flat.append(np.array(mine, dtype=np.int32))
            used += len(mine)
        return np.concatenate(flat), begin, n, good

    def decode_bytes(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Texts as bytes, without the blank that the model puts first."""
        size = self.piece_len[ids]
        out = self.piece_bytes[ragged(self.piece_at[ids], size)].tobytes()
        end = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)]
        begin = np.concatenate([[0], end[:-1]])
        skip = int(self.model.dummy_prefix)
        return [out[a + skip : b] if out[a : a + 1] == b" " else out[a:b] for a, b in zip(begin, end, strict=True)]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` without text, with ids, round_trip and parity. ``model``: path on every executor."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "ids", "round_trip", "parity")]
    schema = docs.select(*kept).withColumns({"ids": F.lit(None).cast("array<int>"), "round_trip": F.lit(None).cast("boolean"), "parity": F.lit(None).cast("boolean")}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            null = np.array([t is None for t in texts], dtype=bool)
            some = [t or "" for t in texts]
            flat, n, same = c.encode_ragged(some, verify)
            trip = [a == b.encode() for a, b in zip(c.decode_bytes(flat, n), some, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(trip, pa.bool_(), mask=null), pa.array(same, pa.bool_(), mask=null | (not verify))], [*kept, "ids", "round_trip", "parity"],
            )

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to null."""
    prepare(encoded.sparkSession)
    kept = [c for c in encoded.columns if c not in (ids, text)]
    schema = encoded.select(*kept).withColumn(text, F.lit(None).cast("string")).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            rows = batch.column(len(kept)).to_pylist()
            some = [i for i, r in enumerate(rows) if r is not None]
            out: list = [None] * len(rows)
            for i, t in zip(some, c.decode([rows[i] for i in some]), strict=True):
                out[i] = t
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], [*kept, text])

    return encoded.select(*kept, ids).mapInArrow(run, schema)


def op4_sentencepiece_codec(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    n = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip", "parity")
