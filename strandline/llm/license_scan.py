"""Licence scan by Dice coefficient over word bigrams; DataFrame functions only.

A unit is a line, a paragraph (lines up to a blank one), a whole text or, with ``runs`` as
in the query, a run of neighbouring lines, across blank ones too. Units and templates are
normalised to runs of ASCII letters and digits, letters lower-cased, and compared by

    dice = 2 * |A & B| / (|A| + |B|)

over their sets of word bigrams. At a threshold t a template of n bigrams can only match
units of t / (2 - t) * n to (2 - t) / t * n bigrams, which prunes templates per unit, and
only units that share one of any ``n - ceil(t / (2 - t) * n) + 1`` of its bigrams. These
are chosen to have few words in common; texts and lines without such a word are passed
over before they are cut into words.
No pruning step loses a match. The plan is two narrow passes, one for runs: templates are
literals. Runs are cut only from texts that share ``t / (2 - t)`` of a template's bigrams,
begin in lines with bigrams of such templates (without its first line another run does no
worse) and grow until they have too many bigrams.

Defined results: null or empty texts and empty tables give no row; texts of any length are
cut into all their units; columns named like a result give way to it; a unit matches its
best template, ties go to the template named first; repeated rows each give their matches;
a paragraph or text that is a single line is reported as a line only. Of overlapping runs
and lines of one licence the best counts (then the one with more bigrams, the shorter, the
first); one inside a better one of any licence is passed over. A run (unit ``lines``,
numbered by its first line) is reported unless its paragraph or the text matches that
licence.
"""

from __future__ import annotations

import math
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
#: (licence, template text); fixed values. Long licences are known by their notices and by
#: the title paragraph of their full text; ``templates`` of ``scan`` may hold whole texts too.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("BSD-2-Clause", _BSD_GRANT),
    ("BSD-3-Clause", f"{_BSD_GRANT} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", _GPL.format(2)),
    ("GPL-3.0-or-later", _GPL.format(3)),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


#: Words too common in prose to select documents by, unless nothing else is left.
COMMON = frozenset("the and this with without under that for any all are not but from have has was were which will may can you your its our their such other more than then into each same following above copy subject".split())


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of an ASCII text, in order of occurrence."""
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(sets: list[list[str]], threshold: float) -> tuple[list[str], list[str]]:
    """(bigrams, words): no matching unit avoids all the bigrams, and each holds one of the words.

    A template of n bigrams needs any ``n - ceil(t / (2 - t) * n) + 1`` of its own. They
    are chosen greedily so that few words, preferably long ones, occur in all of them.
    """
    need = [len(b) - math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) + 1 for b in sets]
    open_: list[set[str]] = [set(b) for b in sets]
    chosen, words = set(), []
    while any(need):
        gain: dict[str, float] = {}
        for left, n in zip(open_, need, strict=True):
            for w in {w for b in left for w in b.split()} if n else ():
                here = sum(w in b.split() for b in left)
                gain[w] = gain.get(w, 0.0) + min(n, here) * (0.01 if w in COMMON or len(w) < 3 else min(len(w), 8) ** 2)
        word = max(sorted(gain), key=gain.get)
        words.append(word)
        for i, left in enumerate(open_):
            for b in [x for x in sorted(left) if word in x.split()][: need[i]]:
                left.discard(b)
                chosen.add(b)
                need[i] -= 1
    return sorted(chosen), [w for w in words if not any(v != w and v in w for v in words)]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = lambda w, n: F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, F.lit(" "), b))
    return _let(words, lambda w: pairs(w, F.greatest(F.size(w) - 1, F.lit(0))))


def bigram_hash(bigram: str) -> int:
    """The value that ``xxhash64(first, ' ', second)`` gives: each part seeds the next."""
    first, second = bigram.split(" ")
    seed = 42
    for part in (first, " ", second):
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _longs(bigrams: list[str]) -> str:
    return f"array({', '.join(f'{bigram_hash(b)}L' for b in bigrams)})".replace("-9223372036854775808L", "bigint(-9223372036854775808)")


def _runs(may: DataFrame, own: list[str], known: Column, every: Column, best, threshold: float) -> DataFrame:
    """``own`` and __m (unit, unit_no, license, dice) of the runs of lines. ``may``: own, __text."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    distinct = lambda words: F.array_distinct(_bigrams(words))
    # generators, so that each step is computed once and only for the texts that are left
    step = lambda df, value, keep, name: df.select(*own, *(c for c in df.columns if c not in own), F.explode(F.filter(F.array(value), keep)).alias(name))

    def shared(b: Column) -> Column:
        hits = F.array_intersect(b, every)
        near = lambda h: F.filter(known, lambda t: F.size(F.array_intersect(h, t["bigrams"])) >= t["n"] * low - 1e-9)
        return _let(hits, lambda h: F.struct(b.alias("all"), h.alias("hits"), near(h).alias("near")))

    texts = may.where(F.contains(F.trim("__text", F.lit("\n \t\r")), F.lit("\n")))
    texts = step(texts, _let(distinct(_words(F.col("__text"))), shared), lambda d: F.size(d["near"]) > 0, "__d")
    lines = F.transform(F.split("__text", "\n"), lambda x, k: F.struct(k.cast("long").alias("no"), _words(x).alias("words"), (F.trim(x, F.lit(" \t\r")) == "").alias("blank")))
    texts = step(texts, lines, lambda x: F.lit(True), "__lines")
    texts = step(texts, F.filter("__lines", lambda x: F.size(x["words"]) > 0), lambda p: F.size(p) > 1, "__p")
    parts, near = F.col("__p"), F.col("__d.near")
    most = F.array_max(F.transform(near, lambda t: t["n"])) * high + 1e-9
    kind = "array<struct<first:bigint,last:bigint,n:int,dice:double,license:string>>"

    def from_line(start: Column) -> Column:
        """The matching runs that begin in a line, the line itself among them."""

        def grow(state: Column, line: Column) -> Column:
            def score(b: Column) -> Column:
                run = lambda m: F.struct(start["no"].alias("first"), line["no"].alias("last"), F.size(b).alias("n"), m["dice"].alias("dice"), m["license"].alias("license"))
                new = F.transform(F.filter(F.array(best(b, near)), lambda m: m["dice"] >= threshold), run)
                return F.struct(F.slice(line["words"], -1, 1).alias("tail"), b.alias("set"), F.concat(state["out"], new).alias("out"))

            grown = F.array_distinct(F.concat(state["set"], _bigrams(F.concat(state["tail"], line["words"]))))
            return F.when(F.size(state["set"]) > most, state).otherwise(_let(grown, score))

        zero = F.struct(F.array().cast("array<string>").alias("tail"), F.array().cast("array<bigint>").alias("set"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.filter(parts, lambda x: x["no"] >= start["no"]), zero, grow, lambda state: state["out"])

    after = lambda k: F.coalesce(F.slice(F.get(parts, k + 1)["words"], 1, 1), F.array().cast("array<string>"))
    starts = F.filter(parts, lambda x, k: F.arrays_overlap(_bigrams(F.concat(x["words"], after(k))), F.col("__d.hits")))
    texts = step(texts, F.flatten(F.transform(starts, from_line)), lambda c: F.exists(c, lambda r: r["last"] > r["first"]), "__c")
    ranked = F.array_sort(F.transform("__c", lambda r: F.struct((-r["dice"]).alias("by"), (-r["n"]).alias("size"), (r["last"] - r["first"]).alias("length"), r["first"].alias("first"), r["last"].alias("last"), r["license"].alias("license"))))

    def keep(kept: Column, r: Column) -> Column:
        overlaps = lambda o: (o["license"] == r["license"]) & (o["first"] <= r["last"]) & (r["first"] <= o["last"])
        taken = F.exists(kept, lambda o: overlaps(o) | ((o["first"] <= r["first"]) & (r["last"] <= o["last"])))
        return F.when(taken, kept).otherwise(F.array_append(kept, r))

    none = F.array().cast("array<struct<by:double,size:int,length:bigint,first:bigint,last:bigint,license:string>>")
    texts = step(texts, F.aggregate(ranked, none, keep), lambda c: F.exists(c, lambda r: r["length"] > 0), "__k")
    texts = texts.select(*own, "__d", "__lines", F.explode("__k").alias("__r")).where("__r.length > 0")
    r = F.col("__r")
    blanks = F.transform(F.filter("__lines", lambda x: x["blank"]), lambda x: x["no"])
    begin = F.coalesce(F.array_max(F.filter(blanks, lambda b: b < r["first"])), F.lit(-1))
    end = F.coalesce(F.array_min(F.filter(blanks, lambda b: b > r["first"])), F.size("__lines").cast("long"))
    paragraph = _let(F.struct(begin.alias("begin"), end.alias("end")), lambda p: F.when(r["last"] < p["end"], F.flatten(F.transform(F.filter("__lines", lambda x: (x["no"] > p["begin"]) & (x["no"] < p["end"])), lambda x: x["words"]))))
    same = lambda m: F.coalesce((m["dice"] >= threshold) & (m["license"] == r["license"]), F.lit(False))
    whole = F.exists(F.array(F.col("__d.all"), distinct(paragraph)), lambda b: same(best(b, known)))
    return texts.where(~whole).select(*own, F.struct(F.lit("lines").alias("unit"), r["first"].alias("unit_no"), r["license"].alias("license"), (-r["by"]).alias("dice")).alias("__m"))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, runs: bool = False) -> DataFrame:
    """``docs`` without text, one row per matching unit: unit, unit_no, license, dice; runs of lines only with ``runs``."""
    templates = TEMPLATES if templates is None else templates
    sets = [(name, template_bigrams(body)) for name, body in templates]
    sets = [(name, b) for name, b in sets if b]
    out = ("unit", "unit_no", "license", "dice")
    own = [c for c in docs.columns if c != text and c not in out]
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    known = F.expr("array(" + ", ".join(f"named_struct('name', {quote(name)}, 'no', {i}, 'n', {len(b)}, 'bigrams', {_longs(b)})" for i, (name, b) in enumerate(sets)) + ")")
    chosen, words = anchors([b for _, b in sets], threshold)
    anchor = F.expr(_longs(chosen))

    def may_match(body: Column) -> Column:
        return _let(F.lower(body), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words), F.lit(False)))

    may = docs.select(*own, F.col(text).cast("string").alias("__text")).where(may_match(F.col("__text")))
    lines, paragraphs = F.split("__text", "\n"), F.split("__text", "\n[ \t\r]*\n")
    part = lambda kind, a, keep: F.filter(F.transform(a, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), x.alias("body"))), keep)
    folded = lambda u: F.contains(F.trim(u["body"], F.lit("\n \t\r")), F.lit("\n"))
    units = F.concat(
        part("line", lines, lambda u: F.lit(True)),
        F.when(F.size(paragraphs) > 1, part("paragraph", paragraphs, folded)).otherwise(F.array().cast("array<struct<unit:string,unit_no:bigint,body:string>>")),
        part("text", F.array("__text"), folded),
    )
    unit = may.select(*own, F.explode(units).alias("__u")).where(may_match(F.col("__u.body")))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def best(b: Column, among: Column) -> Column:
        n = F.size(b)
        # size bounds first, the intersection only for templates that are left
        near = F.filter(among, lambda t: (n >= t["n"] * low - 1e-9) & (n <= t["n"] * high + 1e-9))
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(b, t["bigrams"])) / (n + t["n"])).alias("dice"), (-t["no"]).alias("order"), t["name"].alias("license")))
        return F.when(F.arrays_overlap(b, anchor), F.array_max(scored))

    top = _let(F.array_distinct(_bigrams(_words(F.col("__u.body")))), lambda b: best(b, known))
    # a generator, so that the match is computed once and then filtered
    matched = unit.select(*own, "__u", F.explode(F.filter(F.array(top), lambda m: m["dice"] >= threshold)).alias("__m"))
    single = matched.select(*own, F.col("__u.unit").alias("unit"), F.col("__u.unit_no").alias("unit_no"), F.col("__m.license").alias("license"), F.col("__m.dice").alias("dice"))
    if not runs:
        return single
    every = F.expr(_longs(sorted({b for _, bigrams in sets for b in bigrams})))
    return single.unionByName(_runs(may, own, known, every, best, threshold).select(*own, "__m.*"))


def op1_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, runs=True).withColumn("dice", F.round("dice", 6))


def op1_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(TEMPLATES))
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))])"
    return f"""
WITH t AS (SELECT no, name, {pairs} AS b FROM (SELECT no, name, {words("body")} AS w FROM (VALUES {values}) v(no, name, body))),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT r, doc_id, 'line' AS unit, unnest(range(0, len(x))) AS unit_no, unnest(x) AS body FROM (SELECT r, doc_id, string_split(text, chr(10)) AS x FROM d)
  UNION ALL
  SELECT * FROM (SELECT r, doc_id, 'paragraph', unnest(range(0, len(x))), unnest(x) AS body FROM (SELECT r, doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS x FROM d) WHERE len(x) > 1) WHERE contains(trim(body, chr(10) || ' ' || chr(9) || chr(13)), chr(10))
  UNION ALL
  SELECT r, doc_id, 'text', 0, text FROM d WHERE contains(trim(text, chr(10) || ' ' || chr(9) || chr(13)), chr(10))
), ub AS (
  SELECT r, doc_id, unit, unit_no, {pairs} AS b FROM (SELECT *, {words("body")} AS w FROM u)
), m AS (
  SELECT r, doc_id, unit, unit_no, t.no, t.name, 2.0::DOUBLE * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) AS dice
  FROM ub JOIN t ON len(ub.b) BETWEEN len(t.b) * 0.6 AND len(t.b) * 1.6
)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, arg_max(name, (dice, -no)) AS license, round(max(dice), 6) AS dice
FROM m WHERE dice >= 0.8 GROUP BY r, doc_id, unit, unit_no
"""
