"""Queries over the Parquet tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import frames as fr
from ..operators import intervals as iv
from ..operators import records as rc
from ..operators import segments as sg
from ..operators import selection as sel
from ..operators.evidence import covered, covered_length
from ..sources import adapters as ad
from ..sources.ledger import MAX_SPAN, STEP_BREAKS
from ..sources.tables import staged

DAY = 86_400.0
QUERIES: dict = {}
SQL: dict[str, str] = {}

_FRAMES = """
deltas AS (
  SELECT *, (props->>'k')::BIGINT AS k, abs(value - lag(value) OVER w) AS delta, row_number() OVER w - 1 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), frames AS (
  SELECT user_id AS source_id, n AS frame_no, epoch_us(ts) / 1000000.0::DOUBLE AS time_s, event_type AS digest, delta AS global_delta, delta * (1 + k::DOUBLE / 100) AS max_local_delta,
    floor(delta)::BIGINT AS changed_pixels, delta / 500 * (k::DOUBLE / 50) AS changed_fraction, event_id, props, k FROM deltas
)"""
_RUNS = (
    _FRAMES
    + """, marked AS (
  SELECT *, CASE WHEN lag(digest) OVER w IS NULL OR lag(digest) OVER w <> digest THEN frame_no END AS c FROM frames WINDOW w AS (PARTITION BY source_id ORDER BY frame_no)
), runs AS (
  SELECT *, max(c) OVER (PARTITION BY source_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS exact_start FROM marked
)"""
)
_STATES = (
    _RUNS
    + """, states AS (
  SELECT source_id, exact_start, min(frame_no) AS start_frame, max(frame_no) AS end_frame, min(time_s) AS start_time, max(time_s) AS end_time,
    min(digest) AS digest, max(global_delta) AS global_delta, max(max_local_delta) AS local_delta, max(changed_fraction) AS changed_fraction FROM runs GROUP BY source_id, exact_start
)"""
)
_FLAGS = """SELECT source_id, frame_no, unnest(list_filter([CASE WHEN {distinct_states} AND exact_start = frame_no THEN 'distinct_state' END, CASE WHEN global_delta IS NULL AND frame_no > 0 THEN 'dimension_change' END,
    CASE WHEN global_delta > 0 AND global_delta >= {g} THEN 'global_change' END, CASE WHEN global_delta > 0 AND max_local_delta >= {l} THEN 'local_change' END,
    CASE WHEN global_delta > 0 AND changed_pixels >= {p} THEN 'pixel_change' END], lambda x: x IS NOT NULL)) AS reason FROM runs"""
_REQUESTS = _RUNS + ", flagged AS (\n  " + _FLAGS.format(distinct_states="false", g=100, l=170, p=150) + "\n)"
_CANDIDATES = (
    _REQUESTS
    + """, candidates AS (
  SELECT source_id, exact_start AS frame_no, list_sort(list_distinct(list(reason || '@' || frame_no))) AS reasons, list_sort(list_distinct(list(frame_no))) AS represented
  FROM flagged JOIN runs USING (source_id, frame_no) GROUP BY source_id, exact_start
), native AS (
  SELECT source_id, frame_no FROM runs JOIN labels ON doc_id = event_id WHERE quality = 1
)"""
)


def _walk(states: str, layout: float, fraction: float, dwell: float, span: float) -> str:
    """Islands and buckets of the CTE ``states``: (island, hard), then the walk over each island."""
    return f"""cuts AS (
  SELECT *, CASE WHEN lag(start_frame) OVER w IS NULL THEN NULL WHEN start_frame <> lag(end_frame) OVER w + 1 THEN 'uncomputed gap'
    WHEN coalesce(changed_fraction, 0) >= {fraction} OR coalesce(global_delta, 0) >= {layout} THEN 'layout/control surface change'
    WHEN lag(start_time) OVER w IS NOT NULL AND lag(end_time) OVER w - lag(start_time) OVER w >= {dwell} THEN 'stable dwell exit' END AS hard
  FROM {states} WINDOW w AS (PARTITION BY source_id ORDER BY start_frame)
), islands AS (
  SELECT *, (1 + count(hard) OVER (PARTITION BY source_id ORDER BY start_frame ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM cuts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY start_frame) AS k_in FROM islands
), walk AS (
  SELECT source_id, island, k_in, start_frame, start_frame AS bucket, start_time AS bt, coalesce(hard, 'start/continuation') AS boundary_clue FROM numbered WHERE k_in = 1
  UNION ALL
  SELECT n.source_id, n.island, n.k_in, n.start_frame, CASE WHEN n.start_time - w.bt >= {span} THEN n.start_frame ELSE w.bucket END, CASE WHEN n.start_time - w.bt >= {span} THEN n.start_time ELSE w.bt END,
    CASE WHEN n.start_time - w.bt >= {span} THEN 'context duration bound' ELSE 'start/continuation' END
  FROM walk w JOIN numbered n ON n.source_id = w.source_id AND n.island = w.island AND n.k_in = w.k_in + 1
), bucketed AS (
  SELECT i.*, walk.bucket, walk.boundary_clue, row_number() OVER (PARTITION BY i.source_id, walk.bucket, i.digest ORDER BY i.start_frame) > 1 AS again FROM islands i JOIN walk USING (source_id, start_frame)
), proposals AS (
  SELECT source_id, 'P' || lpad(bucket::VARCHAR, 9, '0') AS id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, arg_min(boundary_clue, start_frame) AS boundary_clue,
    list_sort(list_distinct(list_filter([min(start_frame), max(end_frame), arg_max(start_frame, (local_delta, -start_frame)) FILTER (WHERE local_delta > 0), arg_min(start_frame, (local_delta, start_frame)) FILTER (WHERE local_delta > 0),
      min(start_frame) FILTER (WHERE again)], lambda x: x IS NOT NULL))) AS reps,
    count(*) AS distinct_states, coalesce(list(start_frame ORDER BY start_frame) FILTER (WHERE local_delta > 0 AND coalesce(changed_fraction, 0) < 0.01), []) AS small,
    coalesce(list(start_frame ORDER BY start_frame) FILTER (WHERE again), []) AS retrace, coalesce(list(start_frame ORDER BY start_frame) FILTER (WHERE start_frame = end_frame), []) AS one
  FROM bucketed GROUP BY source_id, bucket
)"""


_ISLANDS = _STATES + ", " + _walk("states", 100.0, 0.25, 43_200, 259_200)
_SPANS = """
spans AS (
  SELECT o_custkey AS key, l_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS "start", (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + l_quantity - 1)::BIGINT AS "end"
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
), merged AS (
  SELECT key, min("start") AS "start", max("end") AS "end" FROM (
    SELECT *, sum(n) OVER (PARTITION BY key ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM spans)) GROUP BY key, island
)"""
_CUES = (
    _FRAMES
    + """, cues AS (SELECT source_id, event_id AS cue, frame_no AS pos, time_s AS a, time_s + 3600 AS b FROM frames WHERE digest = 'error'),
others AS (SELECT source_id, frame_no, event_id, time_s, coalesce(lead(time_s) OVER (PARTITION BY source_id ORDER BY frame_no), time_s) AS end_s FROM frames WHERE digest <> 'error')"""
)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _frames(spark, d):
    return ad.frames(ad.table(spark, d, "events"))


def _runs(spark, d):
    return fr.runs(_frames(spark, d))


def _states(spark, d):
    return fr.states(_runs(spark, d))


def _requests(spark, d):
    return _flagged(_runs(spark, d))


def _flagged(runs):
    return sel.change_reasons(runs, 100.0, 170.0, 150, distinct_states=False)


def _seen(frames, spark, d):
    good = ad.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("event_id"))
    return frames.join(good, "event_id").select("source_id", "frame_no", F.lit("full").alias("kind"), F.lit("native").alias("presentation"))


def _bucketed(spark, d):
    return sg.buckets(sg.hard_breaks(_states(spark, d), **STEP_BREAKS), MAX_SPAN)


def _spans(spark, d):
    o, line = ad.table(spark, d, "orders"), ad.table(spark, d, "lineitem")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("key"), "l_orderkey", day.alias("start"), (day + F.col("l_quantity") - 1).cast("long").alias("end"))


def _cues(spark, d):
    rows = _frames(spark, d)
    cues = rows.where("digest = 'error'").select("source_id", F.col("event_id").alias("cue"), F.col("frame_no").alias("pos"), F.col("time_s").alias("a"), (F.col("time_s") + 3600).alias("b"))
    return cues, iv.display_spans(rows.where("digest <> 'error'").select("source_id", "frame_no", "event_id", "time_s"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH {_RUNS} SELECT source_id, frame_no, exact_start FROM runs")
def frm_run(spark, d):
    return _runs(spark, d).select("source_id", "frame_no", "exact_start")


@query(f"WITH {_STATES} SELECT * FROM states")
def frm_states(spark, d):
    return _states(spark, d)


_LINES = (
    _FRAMES
    + """, told AS (SELECT source_id, frame_no, event_id, CASE WHEN k < 10 THEN NULL ELSE floor(time_s)::BIGINT END AS pts, CASE WHEN k < 5 THEN NULL ELSE floor(time_s)::BIGINT - 40000 * (k % 3) END AS best FROM frames)"""
)


def _lines(spark, d):
    """Index lines of the frames: ``k=v|k=v`` with times that are missing for some."""
    k = F.get_json_object("props", "$.k").cast("long")
    whole = F.floor("time_s").cast("long")
    pts, best = F.when(k < 10, "N/A").otherwise(whole.cast("string")), F.when(k < 5, "").otherwise((whole - 40000 * (k % 3)).cast("string"))
    line = F.concat(F.lit("width=640|height=360|pts_time="), pts, F.lit("|best_effort_timestamp_time="), best)
    return _frames(spark, d).select("source_id", "frame_no", line.alias("line"))


def _indexed(spark, d):
    return ad.index_frames(_lines(spark, d))


@query(f"WITH {_LINES} SELECT source_id, frame_no, coalesce(pts, best)::DOUBLE AS time_s, CASE WHEN pts IS NOT NULL THEN 'pts' WHEN best IS NOT NULL THEN 'best_effort' ELSE 'missing' END AS time_source, 640 AS width, 360 AS height FROM told")
def frm_time(spark, d):
    return _indexed(spark, d).select("source_id", "frame_no", "time_s", "time_source", "width", "height")


@query(f"""WITH {_LINES}, t AS (SELECT *, coalesce(pts, best) AS t FROM told),
g AS (SELECT *, t <= last_value(t IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM t)
SELECT source_id, count(*) FILTER (WHERE pts IS NULL) AS missing_pts, count(*) FILTER (WHERE t IS NULL) AS missing_all_time, count(*) FILTER (WHERE bad) AS non_increasing_time FROM g GROUP BY source_id""")
def frm_anomaly(spark, d):
    return fr.anomalies(_indexed(spark, d))


@query("SELECT event_id, 640 AS width, 360 AS height, CASE WHEN (props->>'k')::BIGINT < 10 THEN NULL ELSE (props->>'k') END AS pts, event_type AS name FROM events WHERE event_type <> 'view'")
def src_kv(spark, d):
    k = F.get_json_object("props", "$.k")
    size = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.lit("width=640|height=360|"))
    line = F.concat(size, F.lit("pts="), F.when(k.cast("long") < 10, "N/A").otherwise(k), F.lit("|name="), "event_type")
    fields = ad.key_value_lines(ad.table(spark, d, "events").select("event_id", line.alias("line")))
    return fields.select("event_id", F.expr("cast(fields['width'] as int)").alias("width"), F.expr("cast(fields['height'] as int)").alias("height"), F.expr("fields['pts']").alias("pts"), F.expr("fields['name']").alias("name"))


@query(f"""WITH {_FRAMES}, p AS (SELECT source_id, frame_no, frame_no - row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS g FROM frames WHERE digest = 'purchase')
SELECT source_id, min(frame_no) AS "start", max(frame_no) AS "end" FROM p GROUP BY source_id, g""")
def frm_ranges(spark, d):
    return fr.ranges(_frames(spark, d).where("digest = 'purchase'"), "frame_no", ["source_id"])


@query(f"""WITH RECURSIVE {_FRAMES}, p AS (SELECT source_id, frame_no, frame_no - row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS g FROM frames WHERE digest = 'purchase'),
r AS (SELECT source_id, min(frame_no) AS a, max(frame_no) AS b FROM p GROUP BY source_id, g),
t AS (SELECT source_id, list(CASE WHEN a = b THEN 'eq(n\\,' || a || ')' ELSE 'between(n\\,' || a || '\\,' || b || ')' END ORDER BY a) AS l FROM r GROUP BY source_id
  UNION ALL SELECT source_id, [CASE WHEN 2 * i + 2 <= len(l) THEN '(' || l[2 * i + 1] || '+' || l[2 * i + 2] || ')' ELSE l[2 * i + 1] END for i in range(0, (len(l) + 1) // 2)] FROM t WHERE len(l) > 1)
SELECT source_id, 'select=' || l[1] AS expression FROM t WHERE len(l) = 1""")
def frm_select_expr(spark, d):
    return fr.select_expression(frm_ranges(spark, d), ["source_id"])


@query(f"""WITH RECURSIVE {_FRAMES}, walk AS (
  SELECT source_id, frame_no, true AS taken, time_s + 86400 AS nxt FROM frames WHERE frame_no = 0
  UNION ALL SELECT f.source_id, f.frame_no, f.time_s >= w.nxt, CASE WHEN f.time_s >= w.nxt THEN f.time_s + 86400 ELSE w.nxt END FROM walk w JOIN frames f ON f.source_id = w.source_id AND f.frame_no = w.frame_no + 1)
SELECT source_id, frame_no FROM walk WHERE taken""")
def sel_anchor(spark, d):
    return sel.anchors(_frames(spark, d), DAY)


@query(f"WITH {_FRAMES} SELECT source_id, min(frame_no) AS frame_no, 'first' AS reason FROM frames GROUP BY source_id UNION ALL SELECT source_id, max(frame_no), 'last_computed' FROM frames GROUP BY source_id")
def sel_first_last(spark, d):
    return sel.first_last(_frames(spark, d))


@query(f"WITH {_REQUESTS} SELECT source_id, frame_no, reason FROM flagged")
def sel_reasons(spark, d):
    return _requests(spark, d)


@query(f"""WITH {_REQUESTS}, n AS (SELECT source_id, frame_no AS o, unnest(range(greatest(0, frame_no - 2), frame_no + 3)) AS frame_no FROM (SELECT DISTINCT source_id, frame_no FROM flagged))
SELECT n.source_id, n.frame_no, 'context_of_' || o AS reason FROM n JOIN frames USING (source_id, frame_no) WHERE n.frame_no <> o""")
def sel_context(spark, d):
    return sel.context(_requests(spark, d), _frames(spark, d), 2)


@query(f"""WITH {_FRAMES}, i AS (SELECT source_id, frame_no, row_number() OVER (PARTITION BY source_id ORDER BY frame_no) AS n FROM frames WHERE time_s BETWEEN 1704500000 AND 1705500000)
SELECT source_id, frame_no FROM i WHERE (n - 1) % 3 = 0""")
def sel_focus(spark, d):
    return sel.focus(_frames(spark, d), 1704500000.0, 1705500000.0, 3)


@query(f"WITH {_CANDIDATES} SELECT source_id, frame_no, array_to_string(reasons, ',') AS reasons, array_to_string(represented, ',') AS represented_requests FROM candidates")
def cand_rebuild(spark, d):
    found = sel.candidates(_requests(spark, d), _runs(spark, d))
    return found.select("source_id", "frame_no", F.array_join("reasons", ",").alias("reasons"), _text("represented_requests").alias("represented_requests"))


@query(f"""WITH {_CANDIDATES}, p AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM native n WHERE n.source_id = c.source_id AND n.frame_no = c.frame_no)),
m AS (SELECT source_id, p.frame_no, r, f.time_s, r - row_number() OVER (PARTITION BY source_id, p.frame_no ORDER BY r) AS g FROM (SELECT source_id, frame_no, unnest(represented) AS r FROM p) p JOIN frames f USING (source_id) WHERE f.frame_no = p.r AND f.time_s BETWEEN 1704500000 AND 1705500000),
u AS (SELECT source_id, frame_no, min(r) AS a, max(r) AS b, floor(arg_min(time_s, r))::BIGINT AS s, floor(arg_max(time_s, r))::BIGINT AS e, list(r ORDER BY r) AS l FROM m GROUP BY source_id, frame_no, g),
h AS (SELECT source_id, frame_no, flatten(list(l ORDER BY a)) AS matched, string_agg(a || '-' || b || '@' || s || '-' || e, ',' ORDER BY a) AS matched_ranges FROM u GROUP BY source_id, frame_no),
q AS (SELECT p.*, matched, matched_ranges, row_number() OVER (PARTITION BY p.source_id ORDER BY matched IS NULL, p.frame_no) AS position FROM p LEFT JOIN h USING (source_id, frame_no))
SELECT source_id, frame_no, matched IS NOT NULL AS in_range, position, coalesce(array_to_string(matched, ','), '') AS matched, coalesce(matched_ranges, '') AS matched_ranges FROM q WHERE position <= 8""")
def queue(spark, d):
    runs = staged(_runs(spark, d), "runs")
    left = sel.pending(sel.candidates(_flagged(runs), runs), _seen(runs, spark, d))
    rows = sel.queue(left, runs, 1704500000.0, 1705500000.0, 8)
    n = lambda c: c.cast("long").cast("string")
    span = F.transform("matched_ranges", lambda r: F.concat(n(r["start_frame"]), F.lit("-"), n(r["end_frame"]), F.lit("@"), n(r["start_time_s"]), F.lit("-"), n(r["end_time_s"])))
    return rows.select("source_id", "frame_no", "in_range", "position", F.coalesce(_text("matched"), F.lit("")).alias("matched"), F.coalesce(F.array_join(span, ","), F.lit("")).alias("matched_ranges"))


@query(f"""WITH {_CANDIDATES}, m AS (SELECT source_id, c.frame_no, array_to_string(reasons, ',') AS reasons, f.time_s, CASE WHEN f.k < 90 THEN 'f' || lpad(c.frame_no::VARCHAR, 9, '0') END AS asset_id,
  EXISTS (SELECT 1 FROM native n WHERE n.source_id = c.source_id AND n.frame_no = c.frame_no) AND f.k < 90 AS viewed FROM candidates c JOIN frames f USING (source_id, frame_no))
SELECT 'all' AS what, * FROM m UNION ALL SELECT 'pending', * FROM m WHERE NOT viewed AND time_s BETWEEN 1704500000 AND 1705500000""")
def cand_manifest(spark, d):
    runs = staged(_runs(spark, d), "runs").withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "width": F.lit(640), "height": F.lit(360)})
    found = sel.candidates(_flagged(runs), runs)
    assets = runs.where("k < 90").select("source_id", "frame_no", sc.asset_id(F.col("frame_no")).alias("id"), F.lit("full").alias("kind"), F.concat(F.lit("evidence/"), sc.asset_id(F.col("frame_no"))).alias("path"))
    views = _seen(runs, spark, d).withColumn("asset_id", sc.asset_id(F.col("frame_no")))
    show = lambda rows, what: rows.select(F.lit(what).alias("what"), "source_id", "frame_no", F.array_join("reasons", ",").alias("reasons"), "time_s", "asset_id", "viewed")
    return show(sel.manifest(found, runs, assets, views), "all").unionByName(show(sel.manifest(found, runs, assets, views, True, 1704500000.0, 1705500000.0), "pending"))


@query(f"WITH RECURSIVE {_ISLANDS} SELECT source_id, start_frame, island, hard FROM islands")
def plan_break_hard(spark, d):
    return sg.islands(sg.hard_breaks(_states(spark, d), **STEP_BREAKS)).select("source_id", "start_frame", "island", "hard")


@query(f"WITH RECURSIVE {_ISLANDS} SELECT source_id, start_frame, bucket, boundary_clue FROM bucketed")
def plan_break(spark, d):
    return _bucketed(spark, d).select("source_id", "start_frame", "bucket", "boundary_clue")


@query(f"WITH RECURSIVE {_ISLANDS} SELECT source_id, start_frame, bucket FROM bucketed WHERE again")
def plan_retrace(spark, d):
    return sg.retraces(_bucketed(spark, d)).select("source_id", "start_frame", "bucket")


def _plan(spark, d):
    return sg.prepare(_states(spark, d), MAX_SPAN, **STEP_BREAKS)


@query(f"WITH RECURSIVE {_ISLANDS} SELECT source_id, id, start_frame, end_frame, boundary_clue, array_to_string(reps, ',') AS representative_frames FROM proposals")
def plan_reps(spark, d):
    return _plan(spark, d)[0].select("source_id", "id", "start_frame", "end_frame", "boundary_clue", _text("representative_frames").alias("representative_frames"))


@query(f"""WITH RECURSIVE {_ISLANDS} SELECT source_id, id, distinct_states, array_to_string(small, ',') AS small_change_frames, array_to_string(retrace, ',') AS retrace_frames, array_to_string(one, ',') AS one_frame_states,
CASE WHEN distinct_states = 1 THEN 'exact' ELSE 'approximate_proposal' END AS merge FROM proposals""")
def plan_risk(spark, d):
    lists = [_text(c).alias(c) for c in ("small_change_frames", "retrace_frames", "one_frame_states")]
    return _plan(spark, d)[0].select("source_id", "id", "distinct_states", *lists, "merge")


@query(f"WITH RECURSIVE {_ISLANDS} SELECT source_id, unnest(reps) AS frame_no, 'layer_overview:' || id AS reason, 'automatic' AS origin FROM proposals")
def plan_prepare(spark, d):
    return _plan(spark, d)[1]


_LAYERED = _STATES + ", " + _walk("states", 5.0, 0.12, 0.75, 15.0)


@query(f"""WITH RECURSIVE {_LAYERED}, ends AS (SELECT source_id, min(frame_no) AS lo, max(frame_no) AS hi FROM runs GROUP BY source_id),
anchor AS (SELECT source_id, frame_no, true AS taken, time_s + 86400 AS nxt FROM frames WHERE frame_no = 0
  UNION ALL SELECT f.source_id, f.frame_no, f.time_s >= w.nxt, CASE WHEN f.time_s >= w.nxt THEN f.time_s + 86400 ELSE w.nxt END FROM anchor w JOIN frames f ON f.source_id = w.source_id AND f.frame_no = w.frame_no + 1),
c1 AS ({_FLAGS.format(distinct_states="true", g=100, l=170, p=150)}), c2 AS ({_FLAGS.format(distinct_states="false", g=100, l=170, p=150)}),
every AS (SELECT 'coverage' AS mode, * FROM c1 UNION ALL SELECT 'changes', * FROM c2),
near AS (SELECT DISTINCT mode, source_id, frame_no AS o, unnest(range(greatest(0, frame_no - 1), frame_no + 2)) AS n FROM every)
SELECT * FROM every UNION SELECT mode, n.source_id, n.n, 'context_of_' || o FROM near n JOIN frames f ON f.source_id = n.source_id AND f.frame_no = n.n WHERE n.n <> o
UNION SELECT mode, source_id, unnest([lo, hi]), unnest(['first', 'last_computed']) FROM ends, (VALUES ('coverage'), ('changes')) m(mode)
UNION SELECT mode, source_id, frame_no, 'time_anchor' FROM anchor, (VALUES ('coverage'), ('changes')) m(mode) WHERE taken
UNION SELECT 'layered', source_id, unnest(reps), 'layer_overview:' || id FROM proposals""")
def sel_mode(spark, d):
    runs = staged(_runs(spark, d), "runs")
    given = {"anchor_seconds": DAY, "global_at": 100.0, "local_at": 170.0, "pixels_at": 150}
    one = lambda mode, **p: sel.select(runs, mode, **p).withColumn("mode", F.lit(mode))
    return one("coverage", **given).unionByName(one("changes", **given)).unionByName(one("layered"))


@query("""
WITH p AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (ORDER BY vec_id) AS u FROM embeddings),
e AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v)::DOUBLE AS x, unnest(u)::DOUBLE AS y FROM p WHERE len(u) = len(v)),
t AS (SELECT vec_id, i // 8 AS tile, avg(abs(x - y)) AS m FROM e GROUP BY vec_id, i // 8),
b AS (SELECT vec_id, max(m) AS m FROM t GROUP BY vec_id),
a AS (SELECT vec_id, avg(abs(x - y)) AS g, count(*) FILTER (WHERE abs(x - y) >= 0.2) AS c, count(*) AS n FROM e GROUP BY vec_id)
SELECT p.vec_id, round(g, 6) AS global_delta, round(b.m, 6) AS max_local_delta, c AS changed_elements, round(c / n::DOUBLE, 6) AS changed_fraction
FROM p LEFT JOIN a USING (vec_id) LEFT JOIN b USING (vec_id)""")
def frm_metrics(spark, d):
    rows = ad.table(spark, d, "embeddings").select("vec_id", "embedding")
    m = fr.vector_metrics(rows, "vec_id", "embedding", 8, 0.2)
    return m.select("vec_id", F.round("global_delta", 6).alias("global_delta"), F.round("max_local_delta", 6).alias("max_local_delta"), "changed_elements", F.round("changed_fraction", 6).alias("changed_fraction"))


_PIXELS = """px AS (
  SELECT label AS source_id, vec_id AS frame_no, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings
), rgb AS (
  SELECT source_id, frame_no, i, floor(abs(v) * 8)::BIGINT % 3 * 100 AS r, floor(abs(v) * 40)::BIGINT % 256 AS g, CASE WHEN v < 0 THEN 9 ELSE 0 END AS b FROM px
), f AS (
  SELECT source_id, frame_no, sha256(encode('8x8:rgb24:') || unhex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY i))) AS digest FROM rgb GROUP BY source_id, frame_no
), l AS (
  SELECT *, lag(frame_no) OVER w AS before, lag(digest) OVER w AS last FROM f WINDOW w AS (PARTITION BY source_id ORDER BY frame_no)
), d AS (
  SELECT l.source_id, l.frame_no, x.i, greatest(abs(x.r - y.r), abs(x.g - y.g), abs(x.b - y.b)) AS delta FROM l JOIN rgb x ON x.source_id = l.source_id AND x.frame_no = l.frame_no JOIN rgb y ON y.source_id = l.source_id AND y.frame_no = l.before AND y.i = x.i
), t AS (
  SELECT source_id, frame_no, i % 8 // 3 * 3 AS x, i // 24 * 3 AS y, avg(delta) AS m FROM d GROUP BY ALL
), best AS (
  SELECT source_id, frame_no, m, x, y FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame_no ORDER BY m DESC, y, x) AS k FROM t) WHERE k = 1
), whole AS (
  SELECT source_id, frame_no, avg(delta) AS g, count(*) FILTER (WHERE delta >= 20) AS c FROM d GROUP BY source_id, frame_no
)"""


@query(f"""WITH {_PIXELS} SELECT l.source_id, l.frame_no, digest, max(CASE WHEN last IS NULL OR last <> digest THEN l.frame_no END) OVER (PARTITION BY l.source_id ORDER BY l.frame_no) AS exact_start,
round(g, 6) AS global_delta, round(m, 6) AS max_local_delta, c AS changed_pixels, round(c / 64.0::DOUBLE, 6) AS changed_fraction, CASE WHEN m IS NOT NULL THEN x || ',' || y || ',' || least(8, x + 3) || ',' || least(8, y + 3) END AS box
FROM l LEFT JOIN whole w ON w.source_id = l.source_id AND w.frame_no = l.frame_no LEFT JOIN best b ON b.source_id = l.source_id AND b.frame_no = l.frame_no""")
def frm_scan(spark, d):
    rows = ad.table(spark, d, "embeddings")
    hex2 = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    pixel = lambda v: F.concat(hex2(F.floor(F.abs(v) * 8) % 3 * 100), hex2(F.floor(F.abs(v) * 40) % 256), hex2(F.when(v < 0, 9).otherwise(0)))
    body = F.unhex(F.array_join(F.transform("embedding", lambda v: pixel(v.cast("double"))), ""))
    images = rows.select(F.col("label").alias("source_id"), F.col("vec_id").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), body.alias("pixels"))
    m = fr.image_metrics(images, 3, 20)
    box = F.array_join(F.transform(F.get("tiles", F.lit(0))["box"], lambda x: x.cast("string")), ",")
    six = [F.round(c, 6).alias(c) for c in ("global_delta", "max_local_delta", "changed_fraction")]
    return m.select("source_id", "frame_no", "digest", "exact_start", *six, "changed_pixels", box.alias("box"))


@query(f'WITH {_SPANS} SELECT key, "start", "end" FROM merged')
def ivl_union(spark, d):
    return iv.union(_spans(spark, d), ["key"])


@query(f"""WITH {_SPANS}, g AS (SELECT key, "end" + 1 AS "start", lead("start") OVER (PARTITION BY key ORDER BY "start") - 1 AS "end" FROM merged) SELECT * FROM g WHERE "end" IS NOT NULL""")
def ivl_complement(spark, d):
    spans = _spans(spark, d)
    bounds = spans.groupBy("key").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return iv.complement(iv.union(spans, ["key"]), bounds, ["key"])


@query(f'WITH {_SPANS} SELECT key, sum("end" - "start" + 1)::BIGINT AS days FROM merged GROUP BY key')
def ivl_length(spark, d):
    return iv.union(_spans(spark, d), ["key"]).groupBy("key").agg(F.sum(F.col("end") - F.col("start") + 1).alias("days"))


@query(f"""WITH {_SPANS}, s AS (SELECT DISTINCT key, l_orderkey, "start", "end" FROM spans), r AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY "start", "end", l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT key, l_orderkey, "start", "end" FROM r WHERE "start" <= reach""")
def ivl_overlap_running(spark, d):
    return iv.overlaps_running(_spans(spark, d).distinct(), ["key"], ["start", "end", "l_orderkey"])


@query(f"""WITH {_SPANS}, s AS (SELECT DISTINCT key, l_orderkey, "start", "end" FROM spans), r AS (SELECT *, lag("end") OVER (PARTITION BY key ORDER BY "start", "end", l_orderkey) AS prev FROM s)
SELECT key, l_orderkey, "start", "end" FROM r WHERE "start" < prev""")
def ivl_overlap_adjacent(spark, d):
    return iv.overlaps_previous(_spans(spark, d).distinct(), ["key"], ["start", "end", "l_orderkey"])


@query(f"WITH {_CUES} SELECT c.source_id, cue, o.frame_no FROM cues c JOIN others o ON o.source_id = c.source_id AND time_s < b AND (end_s > a OR (end_s = a AND end_s = time_s))")
def ivl_align(spark, d):
    cues, spans = _cues(spark, d)
    return iv.align(staged(cues.select("source_id", "cue", "a", "b"), "cues"), staged(spans, "spans")).select("source_id", "cue", "frame_no")


@query(f"WITH {_CUES}, r AS (SELECT *, max(b) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cues) SELECT source_id, cue FROM r WHERE a < reach")
def ivl_cue_overlap(spark, d):
    return iv.cue_overlaps(_cues(spark, d)[0]).select("source_id", "cue")


_ISSUES = (
    _SPANS
    + """, steps AS (SELECT key, l_orderkey AS step_id, min("start") AS "start", max("end") AS "end" FROM spans GROUP BY key, l_orderkey),
issues AS (SELECT key, step_id AS issue_id, "start", "end", CASE WHEN step_id % 100 = 0 THEN [step_id] ELSE [] END AS ids FROM steps)"""
)


@query(f"""WITH {_ISSUES} SELECT key, issue_id, unnest(ids) AS step_id FROM issues UNION ALL SELECT i.key, issue_id, s.step_id FROM issues i JOIN steps s ON s.key = i.key AND s."start" <= i."end" AND s."end" >= i."start" WHERE len(ids) = 0""")
def ivl_intersect_closed(spark, d):
    steps = staged(_spans(spark, d).groupBy("key", F.col("l_orderkey").alias("step_id")).agg(F.min("start").alias("start"), F.max("end").alias("end")), "steps")
    ids = F.when(F.col("step_id") % 100 == 0, F.array("step_id")).otherwise(F.array().cast("array<bigint>"))
    issues = steps.select("key", F.col("step_id").alias("issue_id"), "start", "end", ids.alias("step_ids"))
    return iv.linked_steps(issues, steps, ["key"])


@query(f"""WITH {_RUNS}, v AS (SELECT DISTINCT source_id, exact_start FROM runs JOIN labels ON doc_id = event_id WHERE quality = 1) SELECT source_id, frame_no FROM runs JOIN v USING (source_id, exact_start)""")
def join_state_equiv(spark, d):
    runs = _runs(spark, d)
    return covered(runs.select("source_id", "frame_no"), _seen(runs, spark, d).select("source_id", "frame_no"), runs).select("source_id", "frame_no")


@query("""
WITH s AS (SELECT o_custkey AS source_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step_order, CASE WHEN o_totalprice >= 50000 THEN o_orderstatus END AS v FROM orders),
f AS (SELECT source_id, step_order, 1 AS phase, v FROM s UNION ALL SELECT source_id, step_order, 0, v FROM s WHERE o_orderkey % 2 = 0),
k AS (SELECT *, lag(v) OVER w AS last_value, lag(step_order) OVER w AS last_step FROM f WHERE v IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY step_order, phase))
SELECT source_id, step_order, last_step, v AS "value", last_value FROM k WHERE phase = 0 AND last_value <> v""")
def cont_gap(spark, d):
    from pyspark.sql import Window as W

    o = ad.table(spark, d, "orders")
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    fact = F.create_map(F.lit("status"), F.struct(F.when(F.col("o_totalprice") >= 50000, F.col("o_orderstatus")).alias("value"), F.array(F.lit("seen")).alias("evidence")))
    steps = o.select(F.col("o_custkey").alias("source_id"), n.alias("step_order"), F.when(F.col("o_orderkey") % 2 == 0, fact).alias("before"), fact.alias("after"))
    return rc.discontinuities(rc.facts(steps).where("usable")).select("source_id", "step_order", "last_step", "value", "last_value")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def rel_not_exists(spark, d):
    return rc.missing(ad.table(spark, d, "documents").select("doc_id"), ad.table(spark, d, "labels"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def rc_batch(spark, d):
    return rc.duplicate_ids(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def rel_latest(spark, d):
    return rc.latest(ad.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT user_id AS source_id, event_type AS id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 5 <> 0""")
def rel_upsert(spark, d):
    log = ad.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("id"), F.col("event_id").alias("seq"), "value", (F.col("event_id") % 5 == 0).alias("tombstone"))
    return rc.current(log, ["source_id", "id"]).drop("tombstone")


@query(f"""WITH {_CANDIDATES}, f AS (SELECT source_id, count(*) AS frames, count(DISTINCT exact_start) AS states, min(frame_no) AS lo, max(frame_no) AS hi FROM runs GROUP BY source_id),
v AS (SELECT source_id, count(DISTINCT frame_no) AS viewed_frames FROM native GROUP BY source_id),
c AS (SELECT source_id, count(*) AS candidates, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM native n WHERE n.source_id = k.source_id AND n.frame_no = k.frame_no)) AS pending FROM candidates k GROUP BY source_id)
SELECT source_id, frames, states, lo, hi, coalesce(viewed_frames, 0) AS viewed_frames, coalesce(candidates, 0) AS candidates, coalesce(pending, 0) AS pending, coalesce(pending, 0) = 0 AS complete FROM f LEFT JOIN v USING (source_id) LEFT JOIN c USING (source_id)""")
def agg_status(spark, d):
    runs = staged(_runs(spark, d), "runs")
    native = _seen(runs, spark, d)
    found = sel.candidates(_flagged(runs), runs).select("source_id", "frame_no")
    count = lambda df, name: df.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    left = found.join(native.select("source_id", "frame_no"), ["source_id", "frame_no"], "left_anti")
    base = runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("exact_start").alias("states"), F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    views = native.groupBy("source_id").agg(F.count_distinct("frame_no").alias("viewed_frames"))
    row = base.join(views, "source_id", "left").join(count(found, "candidates"), "source_id", "left").join(count(left, "pending"), "source_id", "left").fillna(0, ["viewed_frames", "candidates", "pending"])
    return row.withColumn("complete", F.col("pending") == 0)


@query(f"""WITH {_RUNS}, c AS (SELECT source_id, frame_no FROM runs WHERE digest IN ('view', 'click')), b AS (SELECT source_id, min(frame_no) AS lo, max(frame_no) AS hi FROM runs GROUP BY source_id)
SELECT source_id, lo, hi, count(c.frame_no) AS covered, hi - lo + 1 - count(c.frame_no) AS uncovered FROM b LEFT JOIN c USING (source_id) GROUP BY source_id, lo, hi""")
def ivl_covered(spark, d):
    runs = _runs(spark, d)
    spans = runs.where("digest in ('view', 'click')").select("source_id", F.col("frame_no").alias("start"), F.col("frame_no").alias("end"))
    return covered_length(spans, runs)


@query("SELECT doc_id, sha256('64x1:rgb24:' || text) AS digest FROM documents")
def frm_digest(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", sc.pixel_digest(F.lit(64), F.lit(1), F.encode("text", "UTF-8")).alias("digest"))


@query(f"""WITH {_FRAMES}, b AS (SELECT source_id, frame_no // 16 AS b, sha256(string_agg(frame_no || '|' || floor(time_s)::BIGINT || '|' || digest, chr(10) ORDER BY frame_no)) AS h FROM frames GROUP BY source_id, frame_no // 16)
SELECT source_id, sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM b GROUP BY source_id""")
def id_index(spark, d):
    parts = [F.col("frame_no"), F.floor("time_s").cast("long"), F.col("digest")]
    return rc.table_fingerprint(_frames(spark, d), ["source_id"], "frame_no", parts, 16)


@query("""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS id FROM customer""")
def id_canonical(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", sc.canonical_hash({"segment": F.col("c_mktsegment"), "key": F.col("c_custkey")}).alias("id"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return ad.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT c_custkey, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 16))::UBIGINT % 97)::BIGINT AS pick FROM customer")
def hash_pick(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", sc.hash_pick(F.col("c_custkey").cast("string"), F.lit(97)).alias("pick"))


@query("""SELECT 'difference' AS op, p_partkey AS k FROM (SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'intersection', p_partkey FROM (SELECT p_partkey FROM part WHERE p_size > 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'union', p_partkey FROM (SELECT p_partkey FROM part WHERE p_size > 25 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def set_algebra(spark, d):
    a = ad.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    b = ad.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(a.subtract(b), "difference").unionByName(tag(a.intersect(b), "intersection")).unionByName(tag(a.union(b).distinct(), "union"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT >= 50")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return ad.table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("""WITH u AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role = 'user')
SELECT conv_id, min(turn) AS "start", max(turn) AS "end" FROM u GROUP BY conv_id, g""")
def turn_ranges(spark, d):
    return fr.ranges(ad.table(spark, d, "conversations").where("role = 'user'"), "turn", ["conv_id"])


@query("""SELECT event_id, CASE WHEN ms >= 3600000 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock
FROM (SELECT event_id, event_id * 1234 AS ms FROM events)""")
def sc_clock_fmt(spark, d):
    return ad.table(spark, d, "events").select("event_id", sc.clock_format(F.col("event_id") * 1234 / 1000.0).alias("clock"))


@query(r"""WITH e AS (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\') AS t FROM pages)
SELECT page_id, coalesce(regexp_replace(regexp_replace(regexp_replace(t, '([`*_\[\]|#])', '\\\1', 'g'), '(\r\n|\n|\r)$', ''), '\r\n|\n|\r', ' / ', 'g'), '未知') AS safe FROM e""")
def sc_escape(spark, d):
    return ad.table(spark, d, "pages").select("page_id", sc.escape_text(F.col("html")).alias("safe"))


@query("SELECT c_custkey, 'f' || lpad(c_custkey::VARCHAR, 9, '0') AS asset, 'step-' || lower(hex(c_name)) AS anchor FROM customer")
def sc_asset_id(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", sc.asset_id(F.col("c_custkey")).alias("asset"), sc.anchor(F.col("c_name")).alias("anchor"))


def entry(spark, d):
    """Events to frames, runs, requests, candidates and the pending queue."""
    return queue(spark, d)
