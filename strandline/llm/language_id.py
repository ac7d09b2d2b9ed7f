"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in stretches of ``STRETCH`` bytes, forwards and backwards, by
two gated recurrent layers; both states together give a distribution over languages at
every byte. A document's probabilities are the mean over its letter bytes, so blanks,
digits and symbols have no say. Training is backpropagation through time over whole
stretches in NumPy (no framework), with every letter byte labelled by its document.

Gates and states use x / (1 + |x|) in place of tanh (and half of one plus it in place of the
logistic function): the same shape at a fraction of the cost. A byte's contribution to all gates
is one column of a table, so a step is a table lookup and one small matrix product for
thousands of stretches at once. The column of the padding is zero and the recurrent part has no
constant, so the backward layer enters a short stretch with a state of exactly zero.

The network is fitted on a bounded sample: at most ``PER_LANGUAGE`` stretches of each
language and ``MAX_TRAIN`` in all, chosen by hashes over all documents with a label; several of one
document only where there are fewer documents than that. Everything else covers every byte of every document.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
if nothing could be learned; otherwise the score is the mean probability of the language
given, and among equals the first by name is given. Documents without language or text are
not learned from. Texts of any length are read whole; repeated rows are judged each; an empty
table gives an empty one. Other columns are carried along, those named like a result give
way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import prepare

STRETCH = 128
HIDDEN = 8
PER_LANGUAGE, MAX_TRAIN = 512, 8192
STEPS, BATCH, RATE = 450, 64, 0.02
UNKNOWN = "und"
PAD = 256
#: Bytes that are letters or parts of letters beyond ASCII.
_LETTER = np.zeros(257, dtype=np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Stretches worked on at once, and the most bytes of their distributions.
WIDE, HELD = 4096, 16 << 20


def stretches(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by stretch (``STRETCH`` rows, padded), and the text of each stretch."""
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    n = -(-lens // STRETCH)
    text_of = np.repeat(np.arange(len(raw)), n)
    out = np.full((int(n.sum()), STRETCH), PAD, dtype=np.int16)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    row0 = np.cumsum(n) - n
    at = np.arange(len(flat)) + np.repeat(row0 * STRETCH - (np.cumsum(lens) - lens), lens)
    out.reshape(-1)[at] = flat
    return np.ascontiguousarray(out.T), text_of


def _squash(x: np.ndarray, work: np.ndarray) -> None:
    """x / (1 + |x|) in place."""
    np.abs(x, out=work)
    work += 1
    x /= work


@dataclass
class Layer:
    """One direction: ``table`` (gates by byte: update, reset, state) and ``u`` (gates by state)."""

    table: np.ndarray
    u: np.ndarray

    def steps(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after each row of ``x``. ``keep`` collects what the way back needs."""
        k, wide = self.u.shape[1], x.shape[1]
        h = np.zeros((k, wide), dtype=np.float32)
        own, g, work = (np.empty((3 * k, wide), dtype=np.float32) for _ in range(3))
        for row in x:
            np.take(self.table, row, axis=1, out=own, mode="clip")
            np.matmul(self.u, h, out=g)
            gates, z, r, n = g[: 2 * k], g[:k], g[k : 2 * k], g[2 * k :]
            gates += own[: 2 * k]
            _squash(gates, work[: 2 * k])
            gates += 1
            gates *= 0.5
            if keep is not None:
                keep.append((h.copy(), gates.copy(), n.copy()))
            n *= r
            n += own[2 * k :]
            _squash(n, work[2 * k :])
            if keep is not None:
                keep[-1] += (n.copy(),)
            h -= n
            h *= z
            h += n
            yield h

    def back(self, x: np.ndarray, dh_at: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u from those of the states at each row."""
        k = self.u.shape[1]
        du, dg_at = np.zeros_like(self.u), np.empty((len(x), *keep[0][1].shape[1:], 3 * k), dtype=np.float32)
        dh = np.zeros_like(keep[0][0])
        for t in range(len(x) - 1, -1, -1):
            h, gates, lin, n = keep[t]
            z, r = gates[:k], gates[k:]
            dh = dh + dh_at[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            flat = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            dg = np.concatenate([dh * (h - n) * flat[:k], dn * lin * flat[k:], dn * r])
            du += dg @ h.T
            dh = dh * z + self.u.T @ dg
            dg[2 * k :] = dn
            dg_at[t] = dg.T
        d, seen = dg_at.reshape(-1, 3 * k), x.reshape(-1)
        dtable = np.stack([np.bincount(seen, weights=d[:, i], minlength=PAD + 1) for i in range(3 * k)]).astype(np.float32)
        dtable[:, PAD] = 0
        return dtable, du


class Network:
    """Two layers and the distribution over ``langs`` at each byte."""

    def __init__(self, langs: Iterable[str], hidden: int = HIDDEN, seed: int = 11):
        self.langs = sorted(langs)
        rng, c = np.random.default_rng(seed), len(self.langs)
        draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.layers = [Layer(draw(0.3, 3 * hidden, PAD + 1), draw(hidden**-0.5, 3 * hidden, hidden)) for _ in range(2)]
        for layer in self.layers:
            layer.table[:, PAD] = 0
        self.out = [draw(hidden**-0.5, c, hidden) for _ in range(2)]
        self.bias = np.zeros((c, 1), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [w for layer in self.layers for w in (layer.table, layer.u)] + [*self.out, self.bias]

    def loss(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over letter bytes and its gradients, in the order of ``weights``."""
        c, flags = len(self.langs), _LETTER[x]
        kept: list[list] = [[], []]
        states = [np.stack([h.copy() for h in self.layers[0].steps(x, kept[0])]), np.stack([h.copy() for h in self.layers[1].steps(x[::-1], kept[1])])[::-1]]
        logits = self.out[0] @ states[0] + self.out[1] @ states[1] + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        total = max(1.0, float(flags.sum()))
        value = -float((np.log(np.maximum(p[:, label, np.arange(x.shape[1])], 1e-30)) * flags).sum()) / total
        d = (p - (np.arange(c)[:, None] == label)) * (flags / total)[:, None, :]
        grads = []
        dout = [np.einsum("tcb,tkb->ck", d, s, optimize=True).astype(np.float32) for s in states]
        for layer, rows, dh, keep in ((self.layers[0], x, self.out[0].T @ d, kept[0]), (self.layers[1], x[::-1], (self.out[1].T @ d)[::-1], kept[1])):
            grads += layer.back(rows, dh, keep)
        return value, [*grads, *dout, d.sum(axis=(0, 2)).reshape(c, 1).astype(np.float32)]

    def fit(self, raw: list[bytes], lang: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> Network:
        """Adam over ``steps`` shuffled batches of stretches; each of ``raw`` is one stretch."""
        x, _ = stretches([r[:STRETCH].ljust(1) for r in raw])
        y = np.array([self.langs.index(v) for v in lang])
        rng, w = np.random.default_rng(seed), self.weights()
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-steps * batch // len(y)))])
        for step in range(1, steps + 1):
            some = order[(step - 1) * batch : step * batch]
            _, grads = self.loss(np.ascontiguousarray(x[:, some]), y[some])
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))))
            now = rate * (1 - 0.9 * step / steps)
            for a, g, m1, v1 in zip(w, grads, m, v, strict=True):
                m1 += 0.1 * (scale * g - m1)
                v1 += 0.01 * ((scale * g) ** 2 - v1)
                a -= now * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-6)
        return self

    def _distributions(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, languages by stretch) for each row of bytes, last row first."""
        held = np.empty((len(x), len(self.langs), x.shape[1]), dtype=np.float32)
        for t, h in enumerate(self.layers[0].steps(x)):
            np.matmul(self.out[0], h, out=held[t])
        for i, h in enumerate(self.layers[1].steps(x[::-1])):
            t = len(x) - 1 - i
            p = held[t]
            p += self.out[1] @ h
            p += self.bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, p

    def _wide(self) -> int:
        return max(1, min(WIDE, HELD // (4 * STRETCH * max(1, len(self.langs)))))

    def positions(self, raw: bytes) -> np.ndarray:
        """The language number at every byte of a text."""
        x, _ = stretches([raw])
        out = np.empty(x.shape, dtype=np.int64)
        for at in range(0, x.shape[1], self._wide()):
            for t, p in self._distributions(x[:, at : at + self._wide()]):
                out[t, at : at + p.shape[1]] = p.argmax(axis=0)
        return out.T.reshape(-1)[: len(raw)]

    def pooled(self, raw: list[bytes]) -> np.ndarray:
        """Languages by text: mean over the letter bytes of each, zeros where there are none."""
        total, n = np.zeros((len(raw), len(self.langs))), np.zeros(len(raw))
        x, text_of = stretches(raw)
        for at in range(0, x.shape[1], self._wide()):
            part = np.ascontiguousarray(x[:, at : at + self._wide()])
            letters, own = _LETTER[part], text_of[at : at + part.shape[1]]
            sums = np.zeros((len(self.langs), part.shape[1]), dtype=np.float32)
            for t, p in self._distributions(part):
                p *= letters[t]
                sums += p
            np.add.at(total, own, sums.T)
            np.add.at(n, own, letters.sum(axis=0))
        return total / np.maximum(n, 1)[:, None]


def training_sample(docs: DataFrame, lang: str, text: str, per_language: int = PER_LANGUAGE, most: int = MAX_TRAIN) -> list[tuple[str, bytes]]:
    """At most ``per_language`` stretches of each language and ``most`` in all, in a fixed order.

    A first pass counts the documents of each language, a second keeps those with a small
    enough hash, about twice as many as wanted; only these are ranked and fetched.
    """
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(*docs.columns).alias("key"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not n:
        return []
    if len(n) > most:
        raise ValueError(f"{len(n)} languages, but at most {most} stretches to learn them from")
    take = min(per_language, most // len(n))
    counts = F.broadcast(docs.sparkSession.createDataFrame(sorted(n.items()), "lang string, n long"))
    near = own.join(counts, "lang").where(F.pmod("key", "n") < 2 * take)
    several = F.explode(F.sequence(F.lit(1), F.ceil(2 * take / F.col("n")).cast("int")))
    near = near.withColumn("i", several).withColumn("key", F.xxhash64("key", "i"))
    raw, last = F.col("text").cast("binary"), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / STRETCH))
    at = (F.pmod("key", last) * STRETCH + 1).cast("int")
    some = near.select("lang", F.xxhash64("key").alias("key"), F.substring(raw, at, F.lit(STRETCH)).alias("piece"))
    some = some.groupBy("lang", "piece").agg(F.min("key").alias("key"))  # rows that repeat are one
    first = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("key", "piece"))).where(F.col("k") <= take)
    return [(r.lang, bytes(r.piece)) for r in first.orderBy("lang", "k").collect()]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", **options) -> Network | None:
    """A network fitted on a sample of ``docs``; None if no document has language and letters."""
    sample = training_sample(docs, lang, text, **options)
    return Network({v for v, _ in sample}).fit([r for _, r in sample], [v for v, _ in sample]) if sample else None


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score in place of the text."""
    prepare(docs.sparkSession)
    names = ["lang_pred", "score"]
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    docs = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*docs.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    for f in schema.fields:
        f.nullable = True
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if spoken:
                p = model.pooled([texts[i].encode() for i in spoken])
                best = p.argmax(axis=1)
                score[spoken] = np.clip(p[np.arange(len(spoken)), best], 0, 1)
                for i, b in zip(spoken, best.tolist(), strict=True):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(lang, pa.string()), pa.array(score)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def op11_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    network = learn(docs.where(part != 2))
    held = F.coalesce(part == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), network)
