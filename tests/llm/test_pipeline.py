"""The pipeline against its stages one document after the other, and the stages on odd tables."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def slow_quality(docs):
    norm = lambda line: " ".join(WORD.findall(re.sub("[0-9]", "0", lower(line))))
    texts = defaultdict(set)
    for d in docs:
        texts[d[3]].add(d[1] or "")
    seen = defaultdict(Counter)
    for host, own in texts.items():
        for t in own:
            seen[host].update({norm(x) for x in t.split("\n")} - {""})
    hot = {h: {k for k, n in c.items() if n > 20 and n > 0.1 * len(texts[h])} for h, c in seen.items()}
    out = []
    for i, t, lang, host, _ in docs:
        w = WORD.findall(t or "")
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        if len(w) < 20 or 100 * len(again) > 30 * len(w):
            continue
        lost = sum(len(WORD.findall(x)) for x in t.split("\n") if norm(x) in hot[host])
        if lost and (len(w) - lost < 20 or len(w) - lost < 0.3 * len(w)):
            continue
        kept = "\n".join(x for x in t.split("\n") if not norm(x) or norm(x) not in hot[host])
        out.append((i, kept, lang, host))
    return out


def slow_join(docs):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(lower(d[1])) for d in docs)]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d[0]), d[0])
    return [d for i, d in enumerate(docs) if d[0] == low[find(i)]]


def slow_decontaminate(docs, items):
    plain = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    kept = []
    for d in docs:
        w = plain(d[1])
        leaked = False
        for item in map(plain, items):
            n = min(len(w), len(item))
            if len(item) >= 5 and n >= 5:
                a = bag(item)
                leaked |= any(sum((a & (b := bag(w[s : s + n]))).values()) >= 0.8 * sum((a | b).values()) for s in range(len(w) - n + 1))
        kept += [] if leaked else [d]
    return kept


def slow_mask(t):
    spans = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            digits = [c for c in m.group() if c.isdigit()]
            fit = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn("".join(digits)), "phone": 10 <= len(digits) <= 15}[kind]
            spans += [(m.start(), kind, m.end())] if fit else []
    out, at = "", 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], list(PATTERNS).index(s[1]))):
        if start >= at:
            out += t[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + t[at:]


def table():
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)] + ["é", "The", "the,"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [" ".join(f"b{rng.randint(0, 90)}" for _ in range(n)) for n in (12, 30, 55)]
    line = "All rights of page 12 reserved by the host"
    docs = [(i, f"{line.replace('12', str(i))}\n{prose(60)}\n{prose(30)}", "en", "big", 0) for i in range(40)]
    base = prose(120)
    near = lambda k: " ".join(w if rng.random() > k else "zz" for w in base.split(" "))
    docs += [(100 + i, near(0.01), "en", "h", 0) for i in range(12)] + [(130 + i, base, "de", f"h{i}", 0) for i in range(4)] + [(140, near(0.2), "en", "h", 0)]
    docs += [(200 + i, f"{prose(40)} {items[i % 3] if i % 2 else items[i % 3].replace(' b', ', B', 3)} {prose(30)}", "en", "h", 0) for i in range(6)]
    docs += [(300, f"{prose(30)} mail me@ex.org or +1 (555) 123-4567 from 10.0.0.1, card 4242 4242 4242 4242. {prose(10)}", "en", "h", 0)]
    docs += [(400, None, "en", "h", 0), (401, "", None, None, 0), (402, "too few words", "en", "h", 0), (403, "a b c d " * 40, "en", "h", 0), (404, line, "en", "big", 0), (405, prose(6000), "fr", "long", 0)]
    rng.shuffle(docs)
    return docs, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = table()
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(*d[:4], len(d[1] or "")) for d in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_equals_the_slow_stages(spark, folder):
    import corpus_pipeline
    import sentencepiece

    docs, items = table()
    kept = slow_join(slow_quality(docs))
    assert len(slow_quality(docs)) < len(docs) - 4 and len(kept) < len(slow_quality(docs)) - 10
    clean = slow_decontaminate(kept, items)
    assert len(clean) < len(kept) - 4
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (lib.encode(t := slow_mask(text)), len(t)) for i, text, _, _ in clean}
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want) and all(r.parity and r.round_trip for r in got)
    assert {r.doc_id: (r.ids, r.n_chars) for r in got} == want


def test_stages_keep_the_columns_of_documents(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"n_shingles": F.lit("x"), "pii_spans": F.lit(1), "kept": F.lit(False), "n_words": F.lit("own"), "__host": F.lit(0)}).drop("__host")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert set(docs.columns) - set(out.columns) <= {"pii_spans"}
    assert out.where("n_shingles = 'x' and n_words = 'own' and not kept").count() == out.count() > 30


def test_stages_on_an_empty_table(spark, folder):
    import corpus_pipeline

    out = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    assert out.count() == 0
