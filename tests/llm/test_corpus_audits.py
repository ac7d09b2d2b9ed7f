"""Language identification, periodic runs and the filter audit: brute force, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import filter_audit, language_id, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- periodic runs ------------------------------------------------------------------------


def slow_runs(x, length=6, exponent=4):
    found = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_words(rng):
    kinds, n, x = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 400]), []
    while len(x) < n:
        if rng.random() < 0.4:
            block = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
            x += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
        else:
            x.append(rng.randrange(kinds))
    return x[:n]


def numbers(x):
    known = {}
    return np.array([known.setdefault(v, len(known)) for v in x], dtype=np.int64)


def test_runs_equal_a_scan_of_every_lag():
    rng = random.Random(3)
    for length, exponent in ((6, 4), (1, 2), (9, 3)):
        for _ in range(60):
            texts = [made_words(rng) for _ in range(rng.randint(1, 12))]
            assert periodic_runs.runs_of([numbers(x) for x in texts], length, exponent) == [slow_runs(x, length, exponent) for x in texts]


@pytest.mark.parametrize("limit", [0, 4, 10**9])
def test_lag_counts_are_exact_whichever_way_they_are_counted(limit, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_frequent", lambda n: np.full(len(n), limit))
    monkeypatch.setattr(periodic_runs, "EXACT", 1 << 12)  # several transforms for each text
    rng = random.Random(4)
    texts = [numbers([int(rng.paretovariate(0.7)) % 50 for _ in range(n)]) for n in (0, 3, 40, 900)]
    lags = np.array([len(x) // 4 for x in texts])
    counts, at, slack = periodic_runs.lag_matches(texts, lags)
    assert not slack.any()
    for x, first, n in zip(texts, at, lags, strict=True):
        assert counts[first : first + n].tolist() == [int((x[q:] == x[:-q]).sum()) for q in range(1, n + 1)]


def test_long_repetitive_texts_are_not_scanned_at_each_multiple(monkeypatch):
    scans = Counter()
    scan = periodic_runs.scan_lag
    monkeypatch.setattr(periodic_runs, "scan_lag", lambda x, q, least: scans.update([q]) or scan(x, q, least))
    block = np.arange(10)
    assert periodic_runs.runs_of([np.tile(block, 30_000)]) == [[(0, 300_000, 10)]] and scans == {10: 1}
    scans.clear()
    assert periodic_runs.runs_of([np.zeros(400_000, dtype=np.int64)]) == [[(0, 400_000, 1)]] and scans == {1: 1}


def contract(doc_id, text):
    """What the query must return, from its definition."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def run_texts():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "\x85 \x85 \x85 \x85 \x85 \x85 x", "A a A a A a A a A", "é è é è é è é è"]
    texts += [" ".join(f"w{v}" + rng.choice(["", "\n", " \t"]) for v in made_words(rng)) for _ in range(60)]
    texts += ["x y z " * 4000 + "end", " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(4000))]
    return texts


def test_periodic_runs_query(spark, tmp_path):
    rows = [(i, t, "own", 5) for i, t in enumerate(run_texts())] + [(3, "b b b b b b b", "own", 5), (3, "b b b b b b b", "own", 5), (None, "c d c d c d c d", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, period long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == Counter(contract(i, t) for i, t, *_ in rows)
    assert sum(1 for r in got if r[1]) > 20 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows)))


def test_periodic_runs_keep_columns_and_take_empty_tables(spark):
    schema = "doc_id long, text string, Runs string, collapsed int, n_words string, source string"
    docs = spark.createDataFrame([(1, "a b a b a b a b c", "x", 1, "y", "s"), (2, None, None, None, None, None)], schema)
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "source", "n_words", "runs", "collapsed"]
    assert {tuple(r) for r in out.select("doc_id", "source", "n_words", F.col("runs").cast("string"), "collapsed").collect()} == {(1, "s", 9, "{0, 8, 2}".join("[]"), "a b c"), (2, None, 0, "[]", "")}
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# -- filter audit -------------------------------------------------------------------------


def slow_audit(docs, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))  # a missing id is nobody
    parts, fails = {}, []
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), smaller), strict=True) if bad})
        parts.setdefault(s or "", []).append((i, fails[-1]))
    out = {}
    for part, own in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                hit = [i for i, bad in own if f in bad and not bad & before]
                total[f] += len(hit)
                kept = sum(not bad & (before | {f}) for _, bad in own)
                out[part, "".join(order), step + 1] = (kept, len(hit), sum(f in bad and bool(bad & before) for _, bad in own), sum(bad == {f} for _, bad in own), sum(i in good for i in hit), sum(i in toxic for i in hit))
        for key in [k for k in out if k[0] == part]:
            out[key] += (total[key[1][key[2] - 1]],)
    return out


def audit_tables():
    rng = random.Random(2)
    texts = [None, "", "A", "x" * 49 + "A", "x" * 50 + "A", " ".join(["a", "b"] * 50), " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i // 2}" for i in range(200)), " ".join(f"w{i // 2}" for i in range(202)) + " w0", "| " * 300, "É" * 300, "\x1c \x85" * 150]
    texts += [" ".join(f"W{rng.randrange(300)}" for _ in range(rng.randint(150, 250))) for _ in range(10)]
    docs = [(i, rng.choice(texts), rng.choice(["s0", "s1", "", None])) for i in range(150)]
    docs += [(3, texts[6], "s0"), (3, texts[6], "s0"), (200, texts[6], "s1"), (None, texts[6], "s1"), (None, "only here", None), (-5, "", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(170), 90)] + [(3, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1)]
    return docs, labels


def test_filter_audit_query(spark, tmp_path):
    docs, labels = audit_tables()
    spark.createDataFrame([(*d, "own", 9) for d in docs], "doc_id long, text string, source string, part string, A int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*x, "own") for x in labels], "doc_id long, quality int, toxic int, source string").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.op13_filter_interaction_audit(spark, str(tmp_path)).collect()}
    want = slow_audit(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})
    assert all(any(v[k] for v in want.values()) for k in range(7))


def test_filter_audit_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert filter_audit.op13_filter_interaction_audit(spark, str(tmp_path)).count() == 0


def test_audit_of_any_flags(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, False), (None, None, True)], "part string, x boolean, y boolean")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(rows, "xy").collect()}
    assert got == {("p", "xy", 1): (1, 2, 0, 1, 3), ("p", "xy", 2): (1, 0, 1, 0, 1), ("p", "yx", 1): (2, 1, 0, 0, 1), ("p", "yx", 2): (1, 1, 1, 1, 3), ("", "xy", 1): (1, 0, 0, 0, 0), ("", "xy", 2): (0, 1, 0, 1, 2), ("", "yx", 1): (0, 1, 0, 1, 2), ("", "yx", 2): (0, 0, 0, 0, 0)}
    for bad in ("", "xx", "abcdefgh"):
        with pytest.raises(ValueError, match="different filters"):
            filter_audit.audit(rows, bad)


def test_outcome_matrices_have_one_outcome_for_each_mask():
    m = filter_audit.outcome_matrices(5)
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    gone_before = 1 - m["kept"] - m["removed"] - m["redundant"]
    assert set(np.unique(gone_before)) == {0, 1} and (m["unique"] <= m["removed"]).all() and not m["removed"][0].any()
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all()  # some step removes every mask but none


# -- language -----------------------------------------------------------------------------


def test_gradients_equal_differences():
    net = language_id.Network(["a", "b", "c"], hidden=3)
    for layer in net.layers:
        layer.table, layer.u = layer.table.astype(np.float64), layer.u.astype(np.float64)
    net.out, net.bias = [o.astype(np.float64) for o in net.out], net.bias.astype(np.float64) + 0.1
    x, _ = language_id.stretches([b"ab c\xc3\xa9 12x" * 2, b"zza b", b"c" * language_id.STRETCH])
    x, y = np.ascontiguousarray(x[:24]), np.array([0, 2, 1])
    _, grads = net.loss(x, y)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads, strict=True):
        assert w.shape == g.shape
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            if w.shape[1] == 257:
                at = (at[0], int(rng.choice([97, 98, 99, 122, 0xC3])))
            was = w[at]
            w[at] = was + 1e-3
            up = net.loss(x, y)[0]
            w[at] = was - 1e-3
            down = net.loss(x, y)[0]
            w[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4 + 2e-2 * abs(g[at])


@pytest.fixture(scope="module")
def network():
    rng = random.Random(1)
    words = {"aa": ["olam", "tiri", "usso", "anna"], "bb": ["schk", "wertz", "grunt", "éß"], "cc": ["яма", "дом", "лес"]}
    rows = [(k, " ".join(rng.choice(v) for _ in range(30)).encode()[:128]) for k, v in words.items() for _ in range(60)]
    return language_id.Network(words).fit([r for _, r in rows], [k for k, _ in rows], steps=60), words


def test_positions_and_pools_do_not_depend_on_the_batch(network, monkeypatch):
    net, words = network
    rng = random.Random(5)
    raw = [" ".join(rng.choice(words[k]) for _ in range(n)).encode() for k in words for n in (1, 20, 400)] + [b"", b"12 34", b"x"]
    p = net.pooled(raw)
    assert p.shape == (12, 3) and [net.langs[i] for i in p[[1, 2, 4, 5, 7, 8]].argmax(axis=1)] == ["aa", "aa", "bb", "bb", "cc", "cc"]
    assert np.allclose(p[:9].sum(axis=1), 1, atol=1e-4) and not p[9:11].any()
    monkeypatch.setattr(language_id, "WIDE", 3)
    assert np.allclose(np.concatenate([net.pooled([r]) for r in raw]), p, atol=1e-4)
    both = raw[2] + b" " + raw[5]
    at = net.positions(both)
    assert len(at) == len(both) and (at[: len(raw[2])] == 0).mean() > 0.9 and (at[len(raw[2]) :] == 1).mean() > 0.9
    assert len(net.positions(b"")) == 0


def test_identify_edge_cases(spark, network):
    net, words = network
    rows = [(1, None), (2, ""), (3, "12 %% \n"), (4, "яма дом"), (5, "яма дом " * 40_000), (None, "olam tiri usso"), (4, "яма дом"), (4, "яма дом"), (6, "½²")]
    docs = spark.createDataFrame([(i, t, "own", 3, "k") for i, t in rows], "doc_id long, text string, score string, Lang_pred int, extra string")
    out = language_id.identify(docs, net)
    assert out.columns == ["doc_id", "extra", "lang_pred", "score"]
    got = Counter((r.doc_id, r.lang_pred, r.score > 0.5) for r in out.collect())
    assert got == Counter({(1, "und", False): 1, (2, "und", False): 1, (3, "und", False): 1, (4, "cc", True): 3, (5, "cc", True): 1, (None, "aa", True): 1, (6, "und", False): 1})
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, None).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), net).count() == 0


def test_training_sample_is_bounded_and_fixed(spark):
    rows = [(i, f"text {i} of some length " * 20, "en" if i % 3 else "fr") for i in range(300)]
    rows += [(7, "one row many times", "fr")] * 400 + [(1, None, "en"), (2, "no language", None), (3, "123", "xx"), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, "lang", "text", per_language=20)
    n = Counter(k for k, _ in sample)
    assert set(n) == {"en", "fr"} and n["en"] == 20 and 0 < n["fr"] <= 20 and all(0 < len(r) <= language_id.STRETCH for _, r in sample)
    assert sample == language_id.training_sample(docs.repartition(7), "lang", "text", per_language=20)
    assert len(language_id.training_sample(docs, "lang", "text", per_language=20, most=10)) <= 10
    with pytest.raises(ValueError, match="languages"):
        language_id.training_sample(docs, "lang", "text", most=1)
    assert language_id.learn(docs.where("lang is null")) is None


def test_language_query_on_held_out_documents(spark, tmp_path):
    tables = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(10_000, None, "en", None, 0), (10_001, "", None, "s", 0), (None, "Le la et des pour aux mentaux.", "fr", "s", 3)]
    tables.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(str(tmp_path / "documents.parquet"))
    out = language_id.op11_language_id(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in tables.select("doc_id", "lang").collect()}
    assert set(got) == set(truth) | {10_000, 10_001, None} and not got[None].held_out
    assert {r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None} == {True}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and (got[10_000].lang_pred, got[10_001].lang_pred) == ("und", "und")


def test_held_out_labels_are_not_read(spark):
    """Other labels of held-out documents and other ids of texts leave the prediction as it is."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    spoiled = docs.withColumn("lang", F.when(part == 2, "zz").otherwise(F.col("lang")))
    samples = [language_id.training_sample(d.where(part != 2), "lang", "text", per_language=16) for d in (docs, spoiled)]
    assert samples[0] == samples[1]
