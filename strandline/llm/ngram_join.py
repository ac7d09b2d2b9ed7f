"""Exact set-similarity join on word shingles with PartEnum signatures.

Two texts link when the Jaccard similarity of their distinct ``shingle``-word shingles
(ASCII case folded) is at least 0.8, that is when their sets differ in at most
(|a| + |b|) / 9 elements.

Method. Sizes fall into bands whose ends differ by a factor of 1.25, so linked sets lie in
the same or in neighbouring bands; a set joins one instance for each such pair of bands.
Let k be the most that two sets of an instance may differ. The instance splits the shingle
domain into k // 2 + 1 first-level parts, so that two of its linked sets differ by at most
one element in some part, and each of these into three second-level parts. Signatures are
the subsets of two of the three: the one differing element spoils two subsets, and the two
sets share the third. Sets that differ in d elements spoil a bounded number of all subsets,
so a set need not sign all: it signs those with at least q shingles, q as large as leaves
one more than d elements can spoil. Of two linked sets the one with the larger q has an
unspoilt subset that both sign, so no link is lost, and subsets with one chance shingle
need not be signed.

Signatures of the whole corpus are counted by the request/answer protocol of
``textblocks``. Two passes then find all links that components need:

1. Every member of a shared signature meets the group's most central member. A large
   group of near copies is thus joined with one comparison for each member.
2. Groups whose members still lie in several components are searched: each member
   outside the group's largest component meets all members of other components. Units
   of this search hold at most ``TILE`` searching and ``TILE`` searched members.

Both passes compare parity sketches before sets: bit i is the parity of the number of
elements hashed to i, so sketches differ in at most as many bits as sets in elements.
Whole sets move only for pairs that the sketches leave, and are compared exactly.

Defined results: null or wordless texts have 0 shingles and link with nothing; fewer than
``shingle`` words form one shingle; rows with the same text are one class; the component
id is the smallest non-null document id of the class' component. Pairs at exactly 0.8 link.
Texts of any length are read whole; an empty table gives an empty one. Columns named like
a result give way to it in ``near_duplicates`` and are kept in ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .skew import HOT, hot_keys, spread_join
from .storage import Scratch, shuffle_partitions
from .wordhash import BASE_A, BASE_B, U, Words, mix

_STRENGTHS = 16
#: Second-level parts of a first-level part; a signature leaves one of them out.
SECONDS = 3
#: Largest sketch of a set in bits; larger sets are pruned less.
SKETCH_BITS = 1 << 14
#: Members on each side of a unit of the second pass.
TILE = 1024
#: Words of 64 bits that the second pass compares at once.
_AT_ONCE = 1 << 21


def band_ends(limit: int) -> np.ndarray:
    """Largest size of each band, until ``limit`` is covered twice over."""
    ends, low = [], 1
    while not ends or ends[-1] < 2 * limit:
        ends.append(low * 5 // 4)
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def shingle_sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted."""
    at = np.flatnonzero(w.left() >= shingle)
    text, h = w.text_of[at], w.windows(shingle, at)
    short = np.flatnonzero((w.n_words > 0) & (w.n_words < shingle))
    for n in range(1, shingle):
        t = short[w.n_words[short] == n]
        text, h = np.append(text, t), np.append(h, mix(w.windows(n, w.first[t]) + U(n)))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def signatures(text: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all subsets of parts that the sets sign."""
    size = np.bincount(text, minlength=n_texts)
    ends = band_ends(int(size.max(initial=1)))
    own = np.searchsorted(ends, size)
    out_text, out_sig = [], []
    for step in (0, 1):  # with smaller or equal bands, then with the next larger one
        instance = own + step
        most = ends[instance]
        firsts = np.where(size > 0, (2 * most // 9) // 2 + 1, 0)
        differ = (size + np.minimum(size * 5 // 4, most)) // 9
        # one element spoils two subsets of its part, a second one there the third
        spoilt = 2 * np.minimum(differ, firsts) + np.maximum(differ - firsts, 0)
        cells = firsts * SECONDS
        base = np.cumsum(cells) - cells
        total = int(cells.sum())
        salt = mix((instance.astype(U) + U(1)) * BASE_A)
        at = ((mix(h ^ salt[text]) >> U(32)) * cells[text].astype(U)) >> U(32)
        seg = base[text] + at.astype(np.int64)
        count = np.bincount(seg, minlength=total)
        sums = np.zeros(total, dtype=np.uint64)
        np.add.at(sums, seg, mix(h + BASE_B))
        # the subset that leaves out each cell of its first-level part
        rest = lambda x: (x.reshape(-1, SECONDS).sum(axis=1, dtype=x.dtype)[:, None] - x.reshape(-1, SECONDS)).reshape(-1)
        strength = np.minimum(rest(count), _STRENGTHS - 1)
        owner = np.repeat(np.arange(n_texts), cells)
        counts = np.bincount(owner * _STRENGTHS + strength, minlength=n_texts * _STRENGTHS).reshape(n_texts, _STRENGTHS)
        at_least = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        q = (at_least >= (spoilt + 1)[:, None]).sum(axis=1) - 1
        signed = np.flatnonzero(strength >= q[owner])
        left_out = signed - base[owner[signed]]
        out_text.append(owner[signed])
        out_sig.append(mix(rest(sums)[signed] + mix(salt[owner[signed]] + left_out.astype(U))))
    return np.concatenate(out_text), np.concatenate(out_sig)


def sketches(text: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, all words) of parity sketches with 2 to 4 bits for an element.

    The number of words is a power of two; xor of its halves is the sketch of half the size.
    """
    size = np.bincount(text, minlength=n_texts)
    words = np.minimum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(64, 2 * size))).astype(np.int64)) >> 6
    base = np.cumsum(words) - words
    slot = (mix(h + BASE_A) & (words[text].astype(U) * U(64) - U(1))).astype(np.int64)
    bits = np.bincount((base[text] << 6) + slot, minlength=int(words.sum()) << 6).astype(np.uint8) & 1
    return words, np.packbits(bits, bitorder="little").view("<u8")


def _signed(block: tb.Block, shingle: int):
    """Per piece (first text, texts, set texts, set hashes, signing texts, count); and all signatures."""
    pieces, sigs = [], []
    for first, raw, starts in block.pieces():
        w = Words(np.frombuffer(raw, np.uint8), starts, fold_case=True)
        text, h = shingle_sets(w, shingle)
        owner, sig = signatures(text, h, len(starts))
        pieces.append((first, len(starts), text, h, owner))
        sigs.append(sig)
    return pieces, np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)


_FILTER = U(0xFFFFFFFFFFFF0000)  # the six bytes that a request carries
TEXT_SCHEMA = "tid long, digest binary, n_shingles long, centre double, sigs array<long>, sketch array<long>, shingles array<long>"


def signed_texts(scratch: Scratch, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Each distinct text, its set size, its shared signatures and, if any, its set."""
    corpus = tb.build_corpus(scratch, docs, text)
    parts = corpus.parts

    def ask(batches):
        for block, _, _ in tb.read_blocks(batches):
            _, sig = _signed(block, shingle)
            keys, _, multi, _ = tb.distinct_keys(sig & _FILTER, np.zeros(len(sig), bool))
            yield tb.request_batch(0, block.id, parts, keys, None, multi)

    def shared(batches):
        for block, batch, row in tb.read_blocks(batches):
            pieces, sig = _signed(block, shingle)
            keys, _, _, inverse = tb.distinct_keys(sig & _FILTER, np.zeros(len(sig), bool))
            flag = tb.read_bits(batch, row, 0, parts, keys)[inverse] if len(keys) else np.zeros(0, bool)
            taken = 0
            for first, n, text_of, h, owner in pieces:
                own, own_flag = sig[taken : taken + len(owner)], flag[taken : taken + len(owner)]
                taken += len(owner)
                who, what = owner[own_flag], own[own_flag]
                order = np.argsort(who, kind="stable")
                what = what[order].view(np.int64)
                n_sigs = np.bincount(who, minlength=n)
                centre = n_sigs / np.maximum(1, np.bincount(owner, minlength=n))
                size = np.bincount(text_of, minlength=n)
                keep = (n_sigs > 0)[text_of]
                words, sketch = sketches(text_of[keep], h[keep], n)
                sketch = sketch[np.repeat(n_sigs > 0, words)].view(np.int64)
                ids = np.arange(first, first + n)
                offsets = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block.id << 24) + ids, pa.int64()), pa.array([block.digests[k] for k in ids], pa.binary()), pa.array(size, pa.int64()), pa.array(centre, pa.float64()),
                     pa.ListArray.from_arrays(offsets(n_sigs), pa.array(what)), pa.ListArray.from_arrays(offsets(words * (n_sigs > 0)), pa.array(sketch)), pa.ListArray.from_arrays(offsets(size * (n_sigs > 0)), pa.array(h[keep].view(np.int64)))],
                    ["tid", "digest", "n_shingles", "centre", "sigs", "sketch", "shingles"],
                )

    bits = scratch.table(tb.answers(corpus.blocks.mapInArrow(ask, tb.REQUEST_SCHEMA)), "bits")
    texts = scratch.table(tb.with_answers(corpus, bits).mapInArrow(shared, TEXT_SCHEMA), "texts")
    scratch.drop("blocks")
    return texts


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""
    x = sets.select(F.col("tid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    y = sets.select(F.col("tid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
    half = lambda p: (F.size(p) / 2).cast("int")
    fold = lambda p, q: F.when(F.size(p) > F.size(q), xor(F.slice(p, 1, half(p)), F.slice(p, half(p) + 1, half(p)))).otherwise(F.col(p))
    differ = F.aggregate(xor("fa", "fb"), F.lit(0), lambda s, w: s + F.bit_count(w))
    both = spread_join(spread_join(pairs, x, "a", "b", hot=hot_keys(pairs, "a")), y, "b", "a", hot=hot_keys(pairs, "b")).where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", fold("sa", "sb").alias("fa"), fold("sb", "sa").alias("fb")).where(9 * differ <= F.col("na") + F.col("nb")).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, with the sizes of intersection and union."""

    def of(end: str, name: str) -> DataFrame:  # the semi-join is broadcast where small, else it shares the join's partitioning
        return sets.join(pairs.select(F.col(end).alias("tid")).distinct(), "tid", "left_semi").select(F.col("tid").alias(end), F.col("shingles").alias(name))

    joined = spread_join(spread_join(pairs, of("a", "sa"), "a", "b"), of("b", "sb"), "b", "a", hot=hot_keys(pairs, "b")).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("inter"), (F.size("sa") + F.size("sb")).alias("both"))
    return joined.select("a", "b", "inter", (F.col("both") - F.col("inter")).alias("union")).where("100 * inter >= 80 * union")


def _close(ids: np.ndarray, comp: np.ndarray, size: np.ndarray, sketch: list[np.ndarray], query: np.ndarray, target: np.ndarray):
    """(a, b) of a unit's searching and searched members that sketches leave, in different components."""
    words = min(len(s) for s in sketch)
    m = np.stack([s if len(s) == words else s[:words] ^ s[words : 2 * words] for s in sketch])
    qs, ts = np.flatnonzero(query), np.flatnonzero(target)
    step = max(1, _AT_ONCE // (words * max(1, len(ts))))
    out = []
    for i in range(0, len(qs), step):
        q = qs[i : i + step]
        differ = np.bitwise_count(m[q][:, None, :] ^ m[ts][None, :, :]).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero((9 * differ <= size[q][:, None] + size[ts][None, :]) & (comp[q][:, None] != comp[ts][None, :]))
        out.append(np.stack([ids[q[x]], ids[ts[y]]]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return np.unique(np.sort(pairs, axis=0), axis=1)


def _search(batches):
    """Pairs of each unit; the rows of a unit follow each other."""
    names = ("sig", "u", "v", "tid", "comp", "n_shingles", "query", "target")
    held: list[tuple] = []  # parts of the unit that the last batch left open

    def close(parts):
        cols = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        a, b = _close(cols[0], cols[1], cols[2], [s for p in parts for s in p[5]], cols[3], cols[4])
        return a, b

    def out(found):
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    last = None
    for batch in batches:
        col = {n: batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in names}
        lists = batch.column(batch.schema.names.index("sketch"))
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        n = batch.num_rows
        new = np.ones(n, dtype=bool)
        new[1:] = (col["sig"][1:] != col["sig"][:-1]) | (col["u"][1:] != col["u"][:-1]) | (col["v"][1:] != col["v"][:-1])
        begins, found = np.flatnonzero(new), []
        for lo, hi in zip(begins, np.append(begins[1:], n), strict=True):
            key = (col["sig"][lo], col["u"][lo], col["v"][lo])
            if held and key != last:
                found.append(close(held))
                held = []
            last = key
            held.append((*(col[c][lo:hi] for c in ("tid", "comp", "n_shingles", "query", "target")), [values[at[i] : at[i + 1]].copy() for i in range(lo, hi)]))
        if found:
            yield out(found)
    if held:
        yield out([close(held)])


def _units(rows: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of groups whose members lie in several components, dealt to units of bounded size."""
    rest = scratch.table(rows.join(labels, "tid").select("sig", "tid", "comp"), "labelled")
    per_comp = rest.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_comp.groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    mixed = mixed.select("sig", F.col("most.comp").alias("main"), tiles(F.col("n") - F.col("most.n")).alias("us"), tiles(F.col("n")).alias("vs"))
    query = F.col("comp") != F.col("main")
    part = lambda k: F.pmod(F.xxhash64("tid"), k).cast("int")
    unit = lambda u, v, q, t: F.struct(u.alias("u"), v.alias("v"), q.alias("query"), t.alias("target"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    upto = lambda k: F.sequence(zero, k - 1)
    asks = F.when(query, F.transform(upto(F.col("vs")), lambda v: unit(part(F.col("us")), v, yes, no)))
    asked = F.transform(upto(F.col("us")), lambda u: unit(u, part(F.col("vs")), no, yes))
    dealt = F.when((F.col("us") == 1) & (F.col("vs") == 1), F.array(unit(zero, zero, query, yes))).otherwise(F.concat(F.coalesce(asks, F.slice(asked, 1, 0)), asked))
    spread = rest.join(mixed, "sig").select("sig", "tid", "comp", F.explode(dealt).alias("x")).select("sig", "tid", "comp", "x.*")
    return spread.join(sets.select("tid", "n_shingles", "sketch"), "tid")


def components(scratch: Scratch, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(tid, comp): the smallest node reachable; label propagation with shortcuts."""
    both = scratch.table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{name}-edges")
    hubs = hot_keys(both, "v")
    labels, step = scratch.table(nodes.select("tid", "comp"), f"{name}-0"), 0
    while True:
        step += 1
        near = spread_join(both, labels.select(F.col("tid").alias("v"), "comp"), "v", "u", hot=hubs).groupBy("u").agg(F.min("comp").alias("low"))
        better = scratch.table(labels.join(near, labels.tid == near.u, "left").select("tid", F.col("comp").alias("old"), F.least("comp", "low").alias("comp")), f"{name}-near-{step}")
        # the label of a label: a component's old label moves as a whole
        moved = better.where("comp < old").groupBy(F.col("old").alias("comp")).agg(F.min("comp").alias("to"))
        jumped = spread_join(better, moved, "comp", "tid", "left").select("tid", "old", F.least("comp", "to").alias("comp"))
        table = scratch.table(jumped, f"{name}-{step}")
        changed = table.where("comp < old").limit(1).count()
        labels = table.select("tid", "comp")
        scratch.drop(f"{name}-near-{step}", f"{name}-{step - 1}")
        if not changed:
            return labels


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def join_texts(docs: DataFrame, text: str = "text", shingle: int = 5, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members``: tid, digest (md5 of the text), n_shingles, comp for each distinct text.
    ``links``: verified pairs of tids with sizes of intersection and union, enough to
    connect every component.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    texts = signed_texts(scratch, docs, text, shingle)
    sets = texts.where(F.size("sigs") > 0).select("tid", "n_shingles", "sketch", "shingles")
    rows = texts.select("tid", "centre", F.explode("sigs").alias("sig"))
    pick = F.max(F.struct("centre", (-F.col("tid")).alias("minus"))).alias("r")
    # groups with the same members are one group
    stats = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("tid").cast("decimal(20,0)")).alias("s"), pick).where("n > 1").select("sig", "n", "s", (-F.col("r.minus")).alias("rep"))
    reps = scratch.table(stats.groupBy("n", "s", "rep").agg(F.min("sig").alias("sig")).select("sig", "rep", "n"), "groups")
    total = reps.agg(F.sum("n")).first()[0] or 1
    hot = reps.where(F.col("n") * HOT > total).select("sig", F.ceil(F.col("n") * HOT / F.lit(total)).alias("__salts"))
    rows = scratch.table(spread_join(rows, reps.select("sig", "rep"), "sig", "tid", hot=hot).select("sig", "tid", "rep"), "members")
    labels = found = None
    if rows.limit(1).count():
        met = scratch.table(rows.where("tid <> rep").select(*_pair("tid", "rep")).distinct(), "met")
        first = scratch.table(_near(met, sets), "pairs-0")
        found = scratch.table(_links(first, sets), "links-0")
        labels = components(scratch, sets.select("tid", F.col("tid").alias("comp")), found, "comp-0")
        units = _units(rows, labels, sets, scratch)
        units = units.repartition(shuffle_partitions(docs.sparkSession), "sig", "u", "v").sortWithinPartitions("sig", "u", "v")
        second = scratch.table(units.mapInArrow(_search, "a long, b long").distinct(), "pairs-1")
        if second.limit(1).count():
            new = scratch.table(_links(second, sets), "links-1")
            found = found.unionByName(new)
            if new.limit(1).count():
                labels = components(scratch, labels, new, "comp-1")
    members = texts.select("tid", "digest", "n_shingles")
    if labels is None:
        empty = docs.sparkSession.createDataFrame([], "a long, b long, inter int, union int")
        return members.withColumn("comp", F.col("tid")), empty
    return members.join(labels, "tid", "left").withColumn("comp", F.coalesce("comp", "tid")), found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with n_shingles and component_id, which replace columns of these names."""
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    docs = docs.drop(*({"n_shingles", "component_id"} - {doc_id, text}))
    others = set(scratch.names)
    members, _ = join_texts(docs, text, shingle, scratch)
    first = docs.where(F.col(text).isNotNull()).groupBy(tb.text_key(text).alias("digest")).agg(F.min(doc_id).alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = scratch.table(members.join(first, "digest").select("digest", "n_shingles", "comp", "first", "copies"), "classes")
    scratch.drop(*(n for n in scratch.names if n not in others and n != "classes"))
    total = texts.agg(F.sum("copies")).first()[0] or 1
    copied = texts.where(F.col("copies") * HOT > total).select(F.col("digest").alias("__digest"), F.ceil(F.col("copies") * HOT / F.lit(total)).alias("__salts"))
    lowest = texts.groupBy("comp").agg(F.min("first").alias("component_id"))
    per_text = spread_join(texts, lowest, "comp", "digest").select(F.col("digest").alias("__digest"), "n_shingles", "component_id")
    keyed = docs.withColumn("__digest", tb.text_key(text))
    joined = spread_join(keyed, per_text, "__digest", doc_id, "left", copied).drop("__digest")
    n = F.coalesce("n_shingles", F.lit(0)).cast("long")
    return joined.withColumn("component_id", F.when(n == 0, F.col(doc_id)).otherwise(F.col("component_id"))).withColumn("n_shingles", n)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the lowest id of each component only; all its columns as they were.

    Rows that repeat an id and its text count once. Rows without an id stay only where
    their whole component has none.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_shingles", "component_id")}
    found = near_duplicates(docs.withColumnsRenamed(own), own.get(doc_id, doc_id), own.get(text, text), scratch=scratch)
    kept = found.where(F.col(own.get(doc_id, doc_id)).eqNullSafe(F.col("component_id"))).drop("n_shingles", "component_id")
    kept = kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
    again = kept.select(doc_id).groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    # texts are shuffled only where some id repeats
    return kept.dropDuplicates([doc_id, text]) if again else kept


def op7_ngram_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), size AS (
  SELECT r, count(*) AS n FROM sh GROUP BY r
), pair AS (
  SELECT a.r AS x, b.r AS y, count(*) AS inter FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r
), link AS (
  SELECT x, y FROM pair JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * inter >= 80 * (p.n + q.n - inter)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT r, r AS t FROM w UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.t
)
SELECT w.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach ON reach.r = w.r JOIN w o ON o.r = reach.t LEFT JOIN size ON size.r = w.r
GROUP BY w.r, w.doc_id
"""
