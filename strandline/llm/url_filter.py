"""URL filter with association rules; DataFrame functions only.

Listed rules decide first: a rule (host, path) fits its host and all subdomains if the
url's path starts with the rule's; the longest wins. The method decides the rest: FP-growth
mines token combinations from labelled urls, rules with enough support and confidence for
a bad label remain, and an inverted index on each rule's rarest token matches them. A url
that any rule matches is blocked.

Tokens: host name, each domain suffix of two or more labels, first labels, path segments
without digits, file endings, query keys, scheme and fragment presence. Training uses all
labelled rows. Rules may hold any number of tokens: a long one can be confident where
none of its parts is. Rules that contain another rule are pruned, which changes no verdict.

Defined results: null urls, or urls without ``://``, have empty host and path and no
tokens; they are allowed. Null labels are not bad. Of listed rules that fit, the longest
text of host and path wins; among equals, that of the earlier host in code-point order.
Repeated pages are judged each; empty tables give empty ones; without labels no rule is
mined. Columns of the pages named like a result give way to it. Tokens of very long urls
are all used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import spread_join
from .storage import Scratch

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_COUNT, MIN_SHARE, MIN_CONFIDENCE = 5, 0.002, 0.6
#: Up to so many rules the index is broadcast; beyond, hot tokens are dealt to several tasks.
BROADCAST_RULES = 20_000
_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, _HOST_PATH, 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule.otherwise(null), verdict.otherwise(null))


def tokens(url: Column) -> Column:
    """Distinct sorted tokens of a url."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    segments = F.transform(F.filter(F.split(p, "/"), lambda s: F.rlike(s, F.lit("^[^0-9]+$"))), lambda s: F.concat(F.lit("p:"), s))
    ending = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.element_at(F.split(s, "="), 1)))
    one = lambda prefix, value, when: F.filter(F.array(F.when(when, F.concat(F.lit(prefix), value))), lambda s: s.isNotNull())
    scheme = one("s:", F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.length(h) > 0)
    every = F.concat(suffixes, one("l:", labels[0], n > 2), segments, one("e:", ending, ending != ""), keys, scheme, one("f:", F.lit("fragment"), F.contains(url, F.lit("#"))))
    return F.when(h != "", F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, bad, n) of the rules. ``labelled``: tokens array<string>, bad boolean."""
    from pyspark.ml.fpm import FPGrowth

    total = labelled.count()
    least = max(min_count, math.ceil(min_share * total))
    empty = labelled.sparkSession.createDataFrame([], T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("bad", T.LongType()), T.StructField("n", T.LongType())]))
    if total < least:
        return empty
    mark = "\0bad"
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(mark))).otherwise(F.col("tokens")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=0.0).fit(items).freqItemsets
    bad = found.where(F.array_contains("items", mark)).select(F.array_sort(F.array_remove("items", mark)).alias("tokens"), F.col("freq").alias("bad"))
    every = found.where(~F.array_contains("items", mark)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    return bad.join(every, "tokens").where((F.size("tokens") >= 1) & (F.col("bad") / F.col("n") >= min_confidence))


def index_of(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """(token, rule_tokens): each rule under its rarest token. ``uses``: token, uses."""
    keyed = rules.select("tokens", F.explode("tokens").alias("token")).join(uses, "token", "left")
    rare = F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))
    return keyed.groupBy("tokens").agg(rare.alias("k")).select(F.col("k.token").alias("token"), F.col("tokens").alias("rule_tokens"))


def minimal(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules that contain no other rule: what the others match, these match too."""
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = scratch.table(index_of(rules, uses), "rule-index")
    rows = rules.select("tokens", F.explode("tokens").alias("token"))
    held = _meet(rows, index, "tokens").where((F.size("rule_tokens") < F.size("tokens")) & (F.size(F.array_except("rule_tokens", "tokens")) == 0))
    return rules.join(held.select("tokens").distinct(), "tokens", "left_anti")


def _meet(rows: DataFrame, index: DataFrame, deal: str) -> DataFrame:
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        return rows.join(F.broadcast(index), "token")
    return spread_join(rows, index, "token", deal)


def match(urls: DataFrame, rules: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``urls`` (url, tokens; distinct) that some rule matches.

    Each rule is indexed by its rarest token; the whole rule is then checked.
    """
    scratch = scratch or Scratch(urls.sparkSession, "urls")
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = scratch.table(index_of(rules, seen), "index")
    near = _meet(urls.select("url", "tokens", F.explode("tokens").alias("token")), index, "url")
    return near.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``labelled``: url string, bad boolean."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    train = scratch.table(labelled.select(tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where(F.size("tokens") > 0), "labelled")
    mined = scratch.table(minimal(scratch.table(mine(train), "mined"), scratch), "rules")
    distinct = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    urls = scratch.table(distinct.select("url", tokens(F.col("url")).alias("tokens")), "urls")
    blocked = scratch.table(match(urls, mined, scratch), "blocked")
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url}))
    hit = blocked.select(F.col("url").alias("__blocked"))
    joined = pages.join(hit, F.col(url) == F.col("__blocked"), "left")
    h, p = host(F.col(url)), path(F.col(url))
    rule, verdict = listed(h, p, RULES if rules is None else rules)
    method = F.when(F.col("__blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.withColumns({"host": h, "path": p, "rule": rule, "verdict": F.coalesce(verdict, method)}).drop("__blocked")


def op2_url_filter(spark, sf_dir):
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labelled = pages.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id")).select("url", bad.alias("bad"))
    return judge(pages.select("page_id", "url"), labelled).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH RECURSIVE part AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), bits AS (
  SELECT *, string_split(host, '.') AS l, regexp_extract(path, '\.([A-Za-z0-9]{1,8})$', 1) AS ext,
    [x for x in string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&') if x <> ''] AS q FROM part
), tok AS (
  SELECT DISTINCT url, t FROM (
    SELECT url, unnest(list_concat(
      [ 'd:' || array_to_string(l[i:], '.') for i in range(1, greatest(len(l), 2)) ],
      CASE WHEN len(l) > 2 THEN ['l:' || l[1]] ELSE [] END,
      ['p:' || s for s in string_split(path, '/') if regexp_full_match(s, '(?s)[^0-9]+')],
      CASE WHEN ext <> '' THEN ['e:' || ext] ELSE [] END,
      ['q:' || string_split(s, '=')[1] for s in q],
      ['s:' || lower(regexp_extract(url, '(?s)^(.*?)://', 1))],
      CASE WHEN contains(url, '#') THEN ['f:fragment'] ELSE [] END)) AS t
    FROM bits WHERE host <> '')
), combo AS (
  SELECT url, [t] AS c, t AS top FROM tok
  UNION ALL SELECT combo.url, list_append(combo.c, tok.t), tok.t FROM combo JOIN tok ON tok.url = combo.url AND tok.t > combo.top
), train AS (
  SELECT part.url, (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM part JOIN labels ON page_id = labels.doc_id WHERE host <> ''
), least AS (
  SELECT greatest(5, ceil(0.002::DOUBLE * count(*))) AS n FROM train
), rules AS (
  SELECT c FROM combo JOIN train USING (url) GROUP BY c
  HAVING count(*) FILTER (WHERE bad) >= (SELECT n FROM least) AND count(*) FILTER (WHERE bad) / count(*)::DOUBLE >= 0.6
), blocked AS (
  SELECT DISTINCT url FROM combo JOIN rules USING (c)
), listed AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM part
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN url IN (SELECT url FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM listed
"""
