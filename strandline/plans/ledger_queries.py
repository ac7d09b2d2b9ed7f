"""Queries over a stand-in ledger of the events table, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import identity as idn
from ..sources import adapters as ad
from ..sources.ledger import Ledger, from_events
from ..sources.tables import staged
from . import audit, layers
from .catalog import _STATES, _text, _walk, query

_id = lambda prefix, n: f"'{prefix}' || lpad(({n})::VARCHAR, 9, '0')"
_SHA = "sha256(source_id || ':' || frame_no)"

_RECORDS = (
    _STATES
    + f""", e AS (SELECT *, {_id("f", "frame_no")} AS fid FROM runs),
st AS (SELECT s.*, a.k AS k0, z.k AS k1, {_id("f", "s.start_frame")} AS fa, {_id("f", "s.end_frame")} AS fz FROM states s
  JOIN runs a ON a.source_id = s.source_id AND a.frame_no = s.start_frame JOIN runs z ON z.source_id = s.source_id AND z.frame_no = s.end_frame),
assets AS (
  SELECT source_id, fid AS id, frame_no, 'full' AS kind, NULL::VARCHAR AS parent_id, {_SHA} AS sha FROM e WHERE k < 90
  UNION ALL SELECT source_id, fid || '-crop-0-0-320-180', frame_no, 'crop', CASE WHEN k >= 10 THEN {_id("f", "frame_no + 1")} ELSE fid END, sha256(source_id || ':' || frame_no || ':crop') FROM e WHERE k < 15
), views AS (
  SELECT source_id, fid || ':ann' AS id, fid AS asset_id, frame_no, 'ann' AS actor, CASE WHEN k IN (5, 6) THEN 'changed' ELSE {_SHA} END AS sha, 'native' AS presentation, CASE WHEN k = 7 THEN ' ' ELSE 'read_image#' || frame_no END AS trace FROM e WHERE k < 60
  UNION ALL SELECT source_id, fid || ':bob', fid, frame_no, 'bob', {_SHA}, CASE WHEN k < 70 THEN 'native' ELSE 'overview' END, 'read_image#' || frame_no FROM e WHERE k BETWEEN 30 AND 79
  UNION ALL SELECT source_id, fid || '-crop-0-0-320-180:ann', fid || '-crop-0-0-320-180', frame_no, 'ann', sha256(source_id || ':' || frame_no || ':crop'), 'native', 'read_image#' || frame_no FROM e WHERE k < 10
), vv AS (
  SELECT v.*, a.kind FROM views v JOIN assets a ON a.source_id = v.source_id AND a.id = v.asset_id AND a.frame_no = v.frame_no AND a.sha = v.sha
), steps AS (
  SELECT source_id, {_id("S", "start_frame")} AS id, start_frame, end_frame + CASE WHEN k0 < 20 THEN 2 ELSE 0 END AS end_frame, CASE WHEN k0 < 70 THEN 'confirmed' WHEN k0 < 85 THEN 'partial' ELSE 'unresolved' END AS status,
    k0, k1, fa, fz, CASE WHEN k0 >= 65 THEN ['u' || k0] ELSE []::VARCHAR[] END AS uncertainties, CASE WHEN k0 BETWEEN 40 AND 44 THEN NULL ELSE 'ann' END AS author,
    CASE WHEN k0 BETWEEN 50 AND 52 THEN [] WHEN fa = fz THEN [fa] ELSE [fa, fz] END AS evidence, k0 NOT BETWEEN 90 AND 92 AS whole, k0 NOT BETWEEN 30 AND 33 AS roles FROM st WHERE digest = 'purchase'
), ordered AS (
  SELECT *, row_number() OVER w AS step_order, lag(end_frame) OVER w AS before_end, [start_frame - 1, start_frame, end_frame, end_frame + 1] AS near FROM steps WINDOW w AS (PARTITION BY source_id ORDER BY start_frame, end_frame, id)
), issues AS (
  SELECT source_id, {_id("I", "frame_no")} AS id, frame_no, fid, k, CASE WHEN k < 40 THEN 'resolved' WHEN k < 70 THEN 'open' ELSE 'blocked' END AS status, CASE WHEN k >= 95 THEN ['S999999999'] ELSE []::VARCHAR[] END AS step_ids, k < 30 AS solved FROM e WHERE digest = 'error'
), coverage AS (
  SELECT source_id, exact_start AS frame_no, end_frame, CASE digest WHEN 'purchase' THEN 'operation' WHEN 'error' THEN 'uncertain' ELSE 'context' END AS classification,
    list_concat(CASE WHEN digest = 'purchase' THEN [{_id("S", "start_frame")}] ELSE [] END, CASE WHEN k0 < 5 THEN ['S000000000'] ELSE [] END) AS step_ids,
    list_concat(CASE WHEN digest = 'error' THEN [{_id("I", "start_frame")}] ELSE [] END, CASE WHEN k0 BETWEEN 10 AND 12 THEN ['I999999999'] ELSE [] END) AS issue_ids, fa, CASE WHEN k0 < 50 THEN 'ann' ELSE 'bob' END AS reviewer,
    [exact_start - 1, exact_start, least(exact_start + 1, end_frame), end_frame, end_frame + 1] AS near FROM st WHERE k0 < 85
)"""
)
LEDGER = (
    _RECORDS
    + ", "
    + _walk("st", 100.0, 0.25, 43_200, 259_200)
    + f""", groups AS (
  SELECT source_id, bucket, max(end_frame) AS last, count(*) AS n, arg_min(k0, start_frame) AS k0, arg_min(digest, start_frame) AS digest, coalesce(list({_id("S", "start_frame")} ORDER BY start_frame) FILTER (WHERE digest = 'purchase'), []) AS within
  FROM bucketed GROUP BY source_id, bucket
), intervals AS (
  SELECT *, {_id("f", "start_frame")} AS fa, {_id("f", "end_frame")} AS fz, [start_frame, end_frame] AS near FROM (
    SELECT source_id, {_id("P", "bucket")} AS id, bucket AS start_frame, last + CASE WHEN k0 < 10 THEN 1 ELSE 0 END AS end_frame, CASE digest WHEN 'purchase' THEN 'operation' WHEN 'error' THEN 'uncertain' ELSE 'context' END AS disposition,
      CASE WHEN n = 1 THEN 'exact' WHEN k0 < 50 THEN 'approximate' WHEN k0 < 70 THEN 'none' ELSE 'exact' END AS merge, CASE WHEN k0 < 30 THEN 'reviewed' WHEN k0 < 60 THEN 'partial' ELSE 'not_reviewed' END AS fine_status,
      CASE WHEN digest = 'purchase' THEN within ELSE [] END AS step_ids, CASE WHEN digest = 'error' THEN [{_id("I", "bucket")}] ELSE [] END AS issue_ids FROM groups WHERE k0 < 90)
)"""
)


def _cited(refs: str) -> str:
    """Findings of evidence of the CTE ``refs`` (source_id, reference, id, near)."""
    known = "EXISTS (SELECT 1 FROM assets a WHERE a.source_id = r.source_id AND a.id = r.id)"
    return f"""SELECT source_id, 'audit_evidence_missing' AS code, reference, near FROM {refs} r WHERE NOT {known}
UNION ALL SELECT source_id, 'audit_evidence_unreviewed', reference, near FROM {refs} r WHERE {known} AND NOT EXISTS (SELECT 1 FROM vv WHERE vv.source_id = r.source_id AND vv.asset_id = r.id)"""


TRANSITIONS = """rawfacts AS (
  SELECT source_id, id, start_frame, end_frame, step_order, near, 0 AS phase, 'before' AS phase_name, 'A.rate' AS key, CASE WHEN k0 < 80 THEN (k0 // 25)::VARCHAR ELSE 'null' END AS value, fa AS ev, k0 NOT BETWEEN 55 AND 57 AS usable FROM ordered WHERE whole AND k0 NOT BETWEEN 93 AND 94
  UNION ALL SELECT source_id, id, start_frame, end_frame, step_order, near, 1, 'after', 'A.rate', (k1 // 25)::VARCHAR, fz, true FROM ordered WHERE whole
  UNION ALL SELECT source_id, id, start_frame, end_frame, step_order, near, 1, 'after', 'file:out', '1', fz, true FROM ordered WHERE whole AND k0 < 20
), known AS (
  SELECT *, lag(value) OVER w AS last_value, lag(end_frame) OVER w AS last_end, lag(id) OVER w AS last_id FROM rawfacts WHERE usable AND value <> 'null' WINDOW w AS (PARTITION BY source_id, key ORDER BY step_order, phase)
), proofs AS (
  SELECT source_id, id, near, fz, unnest(['confirmation', 'result']) AS role, unnest([k0, k1]) AS kk FROM ordered WHERE whole
), judged AS (
  SELECT *, kk < 85 AND kk NOT BETWEEN 45 AND 47 AND (kk >= 75 OR kk < 70) AS fit FROM proofs
), stepcites AS (
  SELECT source_id, id || '.' || phase_name || '.' || key AS reference, ev AS id, near FROM rawfacts WHERE usable
  UNION ALL SELECT source_id, id || '.' || role, fz, near FROM judged WHERE fit AND kk < 70
), trans AS (
  SELECT source_id, 'step_without_state' AS code, id AS reference, near FROM ordered o WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.source_id = o.source_id AND l.id = o.id)
  UNION ALL SELECT source_id, 'step_author_missing', id, near FROM ordered WHERE author IS NULL
  UNION ALL SELECT source_id, 'step_unresolved', id, near FROM ordered WHERE status <> 'confirmed' OR len(uncertainties) > 0
  UNION ALL SELECT source_id, 'step_ranges_overlap', id, near FROM ordered WHERE start_frame < before_end
  UNION ALL SELECT source_id, 'step_transition_missing', id, near FROM ordered WHERE NOT whole
  UNION ALL SELECT source_id, 'step_state_missing', id, near FROM ordered WHERE whole AND k0 BETWEEN 93 AND 94
  UNION ALL SELECT source_id, 'state_fact_invalid', id, near FROM rawfacts WHERE NOT usable
  UNION ALL SELECT source_id, 'state_value_unknown', id, near FROM rawfacts WHERE usable AND value = 'null'
  UNION ALL SELECT source_id, 'state_discontinuity', id, [last_end, start_frame] FROM known WHERE phase = 0 AND last_value <> value
  UNION ALL SELECT k.source_id, 'final_parameter_mismatch', k.id, k.near FROM known k JOIN steps s ON s.source_id = k.source_id AND s.id = k.id WHERE phase = 1 AND key = 'A.rate' AND (s.k0 // 20)::VARCHAR <> value
  UNION ALL SELECT source_id, role || '_gap', id, near FROM judged WHERE NOT fit
  UNION ALL """ + _cited("stepcites") + """
  UNION ALL SELECT source_id, 'unresolved_issue', id, [frame_no, frame_no] FROM issues WHERE NOT solved
)"""

STRICT = (
    "linked AS (SELECT DISTINCT source_id, unnest(step_ids) AS id FROM coverage WHERE classification = 'operation'), " + TRANSITIONS
    + """, covcites AS (SELECT source_id, 'coverage:' || frame_no AS reference, fa AS id, near FROM coverage),
covsteps AS (SELECT source_id, frame_no, end_frame, near, unnest(step_ids) AS id FROM coverage), covissues AS (SELECT source_id, frame_no, near, unnest(issue_ids) AS id FROM coverage),
strict AS (
  SELECT source_id, 'unaccounted_state' AS code, exact_start::VARCHAR AS reference, [exact_start - 1, exact_start, least(exact_start + 1, end_frame), end_frame, end_frame + 1] AS near FROM st WHERE k0 >= 85
  UNION ALL """ + _cited("covcites") + """
  UNION ALL SELECT source_id, 'state_full_view_missing', frame_no::VARCHAR, near FROM coverage c WHERE NOT EXISTS (SELECT 1 FROM vv WHERE vv.source_id = c.source_id AND vv.asset_id = c.fa AND vv.kind = 'full' AND vv.presentation = 'native' AND vv.actor = c.reviewer)
  UNION ALL SELECT source_id, 'coverage_step_missing', frame_no::VARCHAR, near FROM covsteps c WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.source_id = c.source_id AND s.id = c.id)
  UNION ALL SELECT c.source_id, 'coverage_step_outside_state', c.frame_no::VARCHAR, c.near FROM covsteps c JOIN steps s ON s.source_id = c.source_id AND s.id = c.id WHERE s.start_frame > c.end_frame OR s.end_frame < c.frame_no
  UNION ALL SELECT source_id, 'coverage_issue_missing', frame_no::VARCHAR, near FROM covissues c WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.source_id = c.source_id AND i.id = c.id)
  UNION ALL SELECT source_id, 'state_unresolved', frame_no::VARCHAR, near FROM coverage WHERE classification = 'uncertain'
  UNION ALL SELECT * FROM trans
)"""
)

_INVALID = """known AS MATERIALIZED (SELECT DISTINCT source_id, id FROM assets),
traced AS MATERIALIZED (SELECT DISTINCT source_id, asset_id AS id FROM vv WHERE trim(trace) <> ''),
sound AS MATERIALIZED (SELECT DISTINCT source_id, id FROM vv), parents AS MATERIALIZED (SELECT DISTINCT source_id, id AS parent_id, frame_no FROM assets),
bounds AS (SELECT source_id, id, unnest([start_frame, end_frame]) AS frame_no FROM steps),
invalid AS (
  SELECT source_id, 'unknown_frame' AS code, id AS reference FROM bounds ANTI JOIN runs USING (source_id, frame_no)
  UNION ALL SELECT source_id, 'missing_evidence', id FROM steps WHERE len(evidence) = 0
  UNION ALL SELECT source_id, 'unknown_evidence', owner FROM owned ANTI JOIN known USING (source_id, id)
  UNION ALL SELECT source_id, 'unreviewed_evidence', owner FROM owned SEMI JOIN known USING (source_id, id) ANTI JOIN traced USING (source_id, id)
  UNION ALL SELECT source_id, 'bad_view_reference', id FROM views ANTI JOIN sound USING (source_id, id)
  UNION ALL SELECT source_id, 'missing_view_trace', id FROM vv WHERE trim(trace) = ''
  UNION ALL SELECT source_id, 'bad_crop_parent', id FROM (SELECT * FROM assets WHERE parent_id IS NOT NULL) ANTI JOIN parents USING (source_id, parent_id, frame_no)
)"""
VALIDATE = """owned AS (SELECT source_id, id AS owner, unnest(evidence) AS id FROM steps UNION ALL SELECT source_id, id, fid FROM issues WHERE k < 20), """ + _INVALID

# an asset's frame was seen by an actor: natively, in full, or any way
COARSE = """mapped AS (
  SELECT i.source_id, i.id, r.exact_start, min(frame_no) AS start_frame, max(frame_no) AS end_frame, max(max_local_delta) AS local_delta, min(digest) AS digest FROM intervals i JOIN runs r ON r.source_id = i.source_id AND r.frame_no BETWEEN i.start_frame AND i.end_frame GROUP BY i.source_id, i.id, r.exact_start
), bound AS (
  SELECT DISTINCT i.source_id, i.id, n, r.exact_start FROM (SELECT source_id, id, unnest(near) AS n FROM intervals) i LEFT JOIN runs r ON r.source_id = i.source_id AND r.frame_no = n
), seenby AS (
  SELECT DISTINCT i.source_id, i.id, r.exact_start FROM (SELECT source_id, id, unnest([fa, fz]) AS ref FROM intervals) i JOIN vv ON vv.source_id = i.source_id AND vv.asset_id = i.ref AND vv.kind = 'full' AND vv.actor = 'ann' JOIN runs r ON r.source_id = vv.source_id AND r.frame_no = vv.frame_no
), coarse AS (
  SELECT source_id, id FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.source_id = i.source_id AND b.id = i.id AND NOT EXISTS (SELECT 1 FROM seenby s WHERE s.source_id = b.source_id AND s.id = b.id AND s.exact_start = b.exact_start))
)"""
FINE = """nativeann AS (SELECT DISTINCT source_id, asset_id FROM vv WHERE presentation = 'native' AND actor = 'ann'),
rolerefs AS (SELECT source_id, id, author, start_frame, end_frame, evidence, unnest(['before', 'during', 'after']) AS role, unnest([fa, fa, fz]) AS ref FROM steps WHERE roles),
placed AS (SELECT r.*, a.frame_no FROM rolerefs r JOIN assets a ON a.source_id = r.source_id AND a.id = r.ref),
sp AS (
  SELECT source_id, id AS step_id, 'operation_roles_missing' AS code, false AS complete FROM steps WHERE NOT roles
  UNION SELECT source_id, id, 'role_evidence_not_declared', false FROM rolerefs WHERE NOT list_contains(evidence, ref)
  UNION SELECT source_id, id, 'operation_native_view_missing', false FROM rolerefs r WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.source_id = r.source_id AND a.id = r.ref)
  UNION SELECT source_id, id, 'operation_native_view_missing', false FROM placed p WHERE author IS NULL OR NOT EXISTS (SELECT 1 FROM nativeann n WHERE n.source_id = p.source_id AND n.asset_id = p.ref)
  UNION SELECT source_id, id, 'role_evidence_outside_step', false FROM placed WHERE frame_no NOT BETWEEN start_frame AND end_frame
  UNION SELECT source_id, id, 'operation_unresolved', true FROM steps WHERE roles AND (status <> 'confirmed' OR len(uncertainties) > 0)
), named AS (
  SELECT source_id, id, start_frame, end_frame, near, fine_status, unnest(step_ids) AS step_id FROM intervals WHERE disposition = 'operation'
), begun AS (SELECT * FROM named WHERE fine_status <> 'not_reviewed'),
links AS (
  SELECT DISTINCT source_id, unnest(step_ids) AS step_id FROM issues WHERE NOT solved
  UNION SELECT i.source_id, s.id FROM issues i JOIN steps s ON s.source_id = i.source_id AND s.start_frame <= i.frame_no AND s.end_frame >= i.frame_no WHERE NOT solved AND len(i.step_ids) = 0
), fine AS (
  SELECT source_id, id, 'operation_not_fine_reviewed' AS code, false AS complete FROM intervals WHERE disposition <> 'operation' OR fine_status = 'not_reviewed'
  UNION SELECT source_id, id, 'operation_not_fine_reviewed', true FROM intervals WHERE disposition = 'operation' AND fine_status = 'partial'
  UNION SELECT source_id, id, 'operation_issue_unresolved', true FROM begun b WHERE EXISTS (SELECT 1 FROM links l WHERE l.source_id = b.source_id AND l.step_id = b.step_id)
  UNION SELECT source_id, id, 'interval_step_missing', false FROM begun b WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.source_id = b.source_id AND s.id = b.step_id)
  UNION SELECT b.source_id, b.id, 'step_outside_interval', false FROM begun b JOIN steps s ON s.source_id = b.source_id AND s.id = b.step_id WHERE s.start_frame < b.start_frame OR s.end_frame > b.end_frame
  UNION SELECT b.source_id, b.id, sp.code, sp.complete FROM begun b JOIN sp ON sp.source_id = b.source_id AND sp.step_id = b.step_id
)"""
INTERVALS = (
    "linked AS (SELECT DISTINCT source_id, unnest(step_ids) AS id FROM intervals WHERE disposition = 'operation'), " + TRANSITIONS + ", " + COARSE + ", " + FINE
    + """, icites AS (SELECT DISTINCT source_id, id AS reference, unnest([fa, fz]) AS id, near FROM intervals),
reach AS (SELECT *, max(end_frame) OVER (PARTITION BY source_id ORDER BY start_frame, end_frame, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r, lead(start_frame) OVER (PARTITION BY source_id ORDER BY start_frame, end_frame, id) AS nxt FROM intervals),
hi AS (SELECT source_id, max(frame_no) AS hi FROM runs GROUP BY source_id),
gaps AS (
  SELECT source_id, coalesce(r, -1) + 1 AS a, start_frame - 1 AS b FROM reach
  UNION ALL SELECT h.source_id, coalesce(max(end_frame), -1) + 1, h.hi FROM hi h LEFT JOIN intervals i ON i.source_id = h.source_id GROUP BY h.source_id, h.hi
), several AS (SELECT source_id, id FROM mapped GROUP BY source_id, id HAVING count(*) > 1),
stepev AS (SELECT n.source_id, n.id, n.step_id, n.near, s.author, unnest(s.evidence) AS ref FROM named n JOIN steps s ON s.source_id = n.source_id AND s.id = n.step_id),
iv AS (
  SELECT source_id, 'interval_gap' AS code, a::VARCHAR AS reference, [a, b] AS near FROM gaps WHERE a <= b
  UNION ALL SELECT source_id, 'interval_overlap', id, [start_frame] FROM reach WHERE start_frame <= r
  UNION ALL """ + _cited("icites") + """
  UNION ALL SELECT source_id, 'interval_overview_missing', id, near FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM coarse c WHERE c.source_id = i.source_id AND c.id = i.id)
  UNION ALL SELECT source_id, CASE WHEN merge = 'exact' THEN 'false_exact_merge' ELSE 'merge_reason_missing' END, id, near FROM intervals JOIN several USING (source_id, id) WHERE merge = 'exact' OR (merge = 'none' AND disposition <> 'operation')
  UNION ALL SELECT source_id, 'interval_issue_missing', id, near FROM (SELECT source_id, id, near, unnest(issue_ids) AS issue FROM intervals) x WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.source_id = x.source_id AND i.id = x.issue)
  UNION ALL SELECT source_id, 'interval_uncertain', id, near FROM intervals WHERE disposition = 'uncertain'
  UNION ALL SELECT DISTINCT f.source_id, f.code, f.id, i.near FROM fine f JOIN intervals i USING (source_id, id) WHERE i.disposition = 'operation'
  UNION ALL SELECT source_id, 'operation_native_view_missing', step_id, near FROM stepev x WHERE author IS NULL OR NOT EXISTS (SELECT 1 FROM nativeann n WHERE n.source_id = x.source_id AND n.asset_id = x.ref)
  UNION ALL SELECT n.source_id, 'file_handoff_state_missing', n.step_id, n.near FROM named n JOIN steps s ON s.source_id = n.source_id AND s.id = n.step_id WHERE s.k0 BETWEEN 20 AND 29
)"""
)
SAMPLE = """scoped AS (
  SELECT i.*, sha256(i.source_id || chr(10) || concat_ws('|', i.id, i.start_frame, i.end_frame, merge, disposition, fine_status, CASE WHEN fa = fz THEN fa ELSE fa || ',' || fz END, array_to_string(step_ids, ','), array_to_string(issue_ids, ',')) || chr(10)
    || coalesce((SELECT string_agg(m.exact_start || ':' || m.start_frame || ':' || m.end_frame || ':' || m.digest, ',' ORDER BY m.start_frame) FROM mapped m WHERE m.source_id = i.source_id AND m.id = i.id), '') || chr(10)
    || coalesce((SELECT string_agg(s.id || ':' || s.status || ':' || s.start_frame || ':' || s.end_frame, ',' ORDER BY s.id) FROM steps s WHERE s.source_id = i.source_id AND list_contains(i.step_ids, s.id)), '')) AS now FROM intervals i
), inner_ AS (
  SELECT m.source_id, m.id, m.start_frame, coalesce(m.local_delta, 0) AS d FROM mapped m JOIN intervals i USING (source_id, id) WHERE m.start_frame > i.start_frame AND m.start_frame < i.end_frame
), picks AS (
  SELECT source_id, id, list(start_frame ORDER BY start_frame) AS l, arg_max(start_frame, (d, -start_frame)) AS s, arg_min(start_frame, (d, start_frame)) FILTER (WHERE d > 0) AS w FROM inner_ GROUP BY source_id, id
), need AS (
  SELECT i.source_id, i.id, i.start_frame, i.end_frame, i.now, i.merge, i.disposition, i.fine_status, i.merge = 'approximate' OR i.disposition = 'context' AS required,
    list_sort(list_distinct(list_filter([s, w, l[1 + (('0x' || substr(now, 1, 16))::UBIGINT % greatest(len(l), 1))::BIGINT], CASE WHEN l IS NULL AND (i.merge = 'approximate' OR i.disposition = 'context') THEN i.start_frame END], lambda x: x IS NOT NULL))) AS frames,
    coalesce((SELECT list(m.start_frame ORDER BY m.start_frame) FROM mapped m WHERE m.source_id = i.source_id AND m.id = i.id), []) AS every,
    row_number() OVER (PARTITION BY i.source_id ORDER BY i.start_frame, i.end_frame, i.id) AS rank FROM scoped i LEFT JOIN picks p USING (source_id, id)
)"""
CHECKS = f"""checks AS (
  SELECT source_id, 'C' || id AS id, id AS interval_id, CASE WHEN disposition = 'uncertain' THEN 'old' ELSE now END AS scope_hash, CASE WHEN fine_status = 'reviewed' THEN 'risk_and_random' ELSE 'exhaustive' END AS method,
    CASE merge WHEN 'approximate' THEN 'clear' WHEN 'exact' THEN 'expand' ELSE 'incomplete' END AS conclusion, CASE WHEN fine_status = 'reviewed' THEN frames ELSE every END AS shown, []::VARCHAR[] AS resolves, every AS prior FROM need WHERE fine_status <> 'not_reviewed'
  UNION ALL SELECT source_id, 'D' || id, id, now, 'exhaustive', 'clear', every, ['C' || id, 'gone'], every FROM need WHERE fine_status = 'reviewed' AND merge = 'exact'
  UNION ALL SELECT source_id, 'R', 'gone', 'old', 'exhaustive', 'expand', [min(start_frame)], [], [min(start_frame)] FROM need GROUP BY source_id
), cevidence AS (SELECT source_id, id, n, {_id("f", "n")} AS ref FROM (SELECT source_id, id, unnest(shown) AS n FROM checks))"""
SAMPLES = """cseen AS (
  SELECT DISTINCT c.source_id, c.id, r.exact_start FROM cevidence c JOIN vv ON vv.source_id = c.source_id AND vv.asset_id = c.ref AND vv.kind = 'full' AND vv.presentation = 'native' AND vv.actor = 'bob' JOIN runs r ON r.source_id = vv.source_id AND r.frame_no = vv.frame_no
), own AS (
  SELECT c.*, n.now, n.rank, n.required, n.frames, n.every, n.start_frame, n.end_frame, CASE WHEN method = 'exhaustive' THEN n.every ELSE n.frames END AS targets FROM checks c JOIN need n ON n.source_id = c.source_id AND n.id = c.interval_id
), cur AS (SELECT * FROM own WHERE scope_hash = now),
lacking AS (
  SELECT DISTINCT t.source_id, t.id FROM (SELECT source_id, id, unnest(targets) AS n FROM cur) t LEFT JOIN runs r ON r.source_id = t.source_id AND r.frame_no = t.n
  WHERE NOT EXISTS (SELECT 1 FROM cseen s WHERE s.source_id = t.source_id AND s.id = t.id AND s.exact_start = r.exact_start)
), valid AS (SELECT * FROM cur c WHERE conclusion = 'clear' AND NOT EXISTS (SELECT 1 FROM lacking l WHERE l.source_id = c.source_id AND l.id = c.id)),
answers AS (
  SELECT a.source_id, a.id, a.ref, a.rank, o.prior, coalesce(a.method = 'exhaustive' AND o.conclusion = 'expand' AND len(o.prior) > 0 AND NOT EXISTS (
    SELECT 1 FROM (SELECT unnest(o.prior) AS n) p LEFT JOIN runs r ON r.source_id = a.source_id AND r.frame_no = p.n WHERE NOT EXISTS (SELECT 1 FROM cseen s WHERE s.source_id = a.source_id AND s.id = a.id AND s.exact_start = r.exact_start)), false) AS good
  FROM (SELECT source_id, id, method, rank, unnest(resolves) AS ref FROM valid) a LEFT JOIN checks o ON o.source_id = a.source_id AND o.id = a.ref
), closed AS (SELECT source_id, ref AS id, min(rank) AS at FROM answers WHERE good GROUP BY source_id, ref),
state AS (
  SELECT n.*, (SELECT count(*) FROM own o WHERE o.source_id = n.source_id AND o.interval_id = n.id) AS n, (SELECT count(*) FROM cur o WHERE o.source_id = n.source_id AND o.interval_id = n.id) AS n_cur,
    (SELECT count(*) FROM cur o WHERE o.source_id = n.source_id AND o.interval_id = n.id AND conclusion = 'expand') AS n_exp, (SELECT count(*) FROM valid o WHERE o.source_id = n.source_id AND o.interval_id = n.id) AS n_val FROM need n
), ccites AS (SELECT c.source_id, c.id AS reference, e.ref AS id, c.frames AS near FROM cur c JOIN cevidence e ON e.source_id = c.source_id AND e.id = c.id),
sampled AS (
  """ + _cited("ccites") + """
  UNION ALL SELECT source_id, 'sample_evidence_incomplete', id, targets FROM cur c WHERE EXISTS (SELECT 1 FROM lacking l WHERE l.source_id = c.source_id AND l.id = c.id)
  UNION ALL SELECT source_id, 'expansion_scope_incomplete', id, coalesce(prior, []) FROM answers WHERE NOT good
  UNION ALL SELECT source_id, 'interval_sample_stale', id, frames FROM state WHERE n > 0 AND n_cur = 0
  UNION ALL SELECT source_id, 'interval_sample_missing', id, frames FROM state WHERE required AND n_cur = 0
  UNION ALL SELECT source_id, 'interval_sample_incomplete', id, frames FROM state WHERE required AND n_cur > 0 AND n_val = 0 AND n_exp = 0
  UNION ALL SELECT o.source_id, 'sample_requires_expansion', o.id, list_concat(list_concat([o.start_frame - 1], o.every), [o.end_frame + 1]) FROM own o LEFT JOIN closed c ON c.source_id = o.source_id AND c.id = o.id WHERE conclusion = 'expand' AND (c.at IS NULL OR c.at > o.rank)
  UNION ALL SELECT c.source_id, 'retired_interval_anomaly', c.id, [] FROM checks c WHERE conclusion = 'expand' AND NOT EXISTS (SELECT 1 FROM need n WHERE n.source_id = c.source_id AND n.id = c.interval_id) AND NOT EXISTS (SELECT 1 FROM closed x WHERE x.source_id = c.source_id AND x.id = c.id)
)"""


def _ledger(spark, d) -> Ledger:
    return from_events(ad.table(spark, d, "events"))


def _shown(findings):
    return findings.select("source_id", "code", "reference", _text("frames").alias("frames"))


_SHOW = "SELECT source_id, code, reference, array_to_string(near, ',') AS frames FROM"


@query(f"WITH {_RECORDS}, {VALIDATE} SELECT source_id, code, reference FROM invalid")
def audit_validate(spark, d):
    return audit.validate(_ledger(spark, d)).select("source_id", "code", "reference")


@query(f"WITH RECURSIVE {LEDGER}, {STRICT} {_SHOW} strict")
def audit_strict(spark, d):
    return _shown(audit.strict(_ledger(spark, d)))


@query(f"WITH RECURSIVE {LEDGER}, {INTERVALS} {_SHOW} (SELECT * FROM iv UNION ALL SELECT * FROM trans)")
def audit_layers(spark, d):
    led = _ledger(spark, d)
    operations = audit.operation_steps(led.intervals.where("disposition = 'operation'"))
    issues = audit.finding(audit.unresolved_issues(led.issues), "unresolved_issue", "id", F.array("start_frame", "end_frame"))
    return _shown(audit.union(layers.intervals(led), audit.transitions(led, operations), issues))


def _checks(led):
    """Stand-in checks of the intervals that were finely looked at, and one of a retired interval."""
    need = led.sampled
    named = lambda c: F.transform(c, lambda n: F.format_string("f%09d", n))
    none = F.array().cast("array<string>")

    def check(rows, id_, interval, scope, method, conclusion, shown, resolves, prior):
        return rows.select("source_id", id_.alias("id"), interval.alias("interval_id"), F.lit("bob").alias("reviewer"), scope.alias("scope_hash"), method.alias("method"), conclusion.alias("conclusion"), named(shown).alias("evidence"), resolves.alias("resolves"), prior.alias("source_scope_frames"))

    risk = F.col("fine_status") == "reviewed"
    prefixed = lambda p: F.concat(F.lit(p), F.col("id"))
    every, conclusion = F.col("all_state_frames"), F.expr("case merge when 'approximate' then 'clear' when 'exact' then 'expand' else 'incomplete' end")
    a = check(need.where("fine_status <> 'not_reviewed'"), prefixed("C"), F.col("id"), F.when(F.col("disposition") == "uncertain", "old").otherwise(F.col("scope_hash")), F.when(risk, "risk_and_random").otherwise("exhaustive"), conclusion, F.when(risk, F.col("frames")).otherwise(every), none, every)
    b = check(need.where("fine_status = 'reviewed' and merge = 'exact'"), prefixed("D"), F.col("id"), F.col("scope_hash"), F.lit("exhaustive"), F.lit("clear"), every, F.array(prefixed("C"), F.lit("gone")), every)
    first = need.groupBy("source_id").agg(F.array(F.min("start_frame")).alias("f"))
    c = check(first, F.lit("R"), F.lit("gone"), F.lit("old"), F.lit("exhaustive"), F.lit("expand"), F.col("f"), none, F.col("f"))
    return staged(a.unionByName(b).unionByName(c), "checks")


@query(f"WITH RECURSIVE {LEDGER}, {COARSE}, {SAMPLE}, {CHECKS}, {SAMPLES} {_SHOW} sampled")
def audit_samples(spark, d):
    led = _ledger(spark, d)
    return _shown(layers.samples(led, _checks(led)))


@query(f"WITH RECURSIVE {LEDGER}, {COARSE}, {SAMPLE} SELECT source_id, id, now AS scope_hash FROM scoped")
def id_scope(spark, d):
    led = _ledger(spark, d)
    return ev.scopes(ev.mapping(led.frames, led.intervals), led.intervals, led.steps)


@query(f"WITH RECURSIVE {LEDGER}, {COARSE}, {SAMPLE} SELECT source_id, id, required, array_to_string(frames, ',') AS frames, array_to_string(every, ',') AS all_state_frames FROM need")
def agg_sample(spark, d):
    return _ledger(spark, d).sampled.select("source_id", "id", "required", _text("frames").alias("frames"), _text("all_state_frames").alias("all_state_frames"))


@query(f"WITH RECURSIVE {LEDGER}, {COARSE} SELECT source_id, id FROM coarse")
def join_coarse_ok(spark, d):
    led = _ledger(spark, d)
    return ev.coarse_reviewed(led.intervals, led.assets, led.views, led.frames)


@query(f"WITH RECURSIVE {LEDGER} SELECT DISTINCT s.source_id, s.id, vv.frame_no FROM (SELECT source_id, id, author, unnest(evidence) AS ref FROM steps) s JOIN vv ON vv.source_id = s.source_id AND vv.asset_id = s.ref AND vv.actor = s.author AND vv.kind = 'full' AND vv.presentation = 'native'")
def join_semi_evidence(spark, d):
    led = _ledger(spark, d)
    refs = led.steps.select("source_id", "id", F.col("author").alias("actor"), F.explode("evidence").alias("asset_id"))
    return ev.seen_through(refs, led.assets, led.views, ["source_id", "id"], native=True, full=True)


@query(f"WITH RECURSIVE {LEDGER}, {FINE} SELECT DISTINCT source_id, id, code, complete FROM fine")
def cont_roles(spark, d):
    return layers.fine_problems(_ledger(spark, d))


_SPAN = """{n}_s AS (SELECT i.source_id, start_frame AS a, end_frame AS b FROM intervals i JOIN coarse c USING (source_id, id) {w}),
{n}_m AS (SELECT source_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM {n}_s)) GROUP BY source_id, g),
{n}_r AS (SELECT source_id, sum(b - a + 1)::BIGINT AS frames, string_agg(a || '-' || b, ',' ORDER BY a) AS ranges FROM {n}_m GROUP BY source_id)"""
_NO = "WHERE NOT EXISTS (SELECT 1 FROM fine f WHERE f.source_id = i.source_id AND f.id = i.id {x})"


@query(f"""WITH RECURSIVE {LEDGER}, {COARSE}, {FINE}, {_SPAN.format(n="coarse", w="")}, {_SPAN.format(n="fine", w=_NO.format(x=""))}, {_SPAN.format(n="examined", w=_NO.format(x="AND NOT complete"))},
u AS (SELECT source_id, count(DISTINCT s) AS units FROM (SELECT source_id, unnest(step_ids) AS s FROM intervals) GROUP BY source_id), m AS (SELECT source_id, count(*) FILTER (WHERE merge = 'approximate') AS merges FROM intervals GROUP BY source_id)
SELECT source_id, coalesce(c.frames, 0) AS coarse_frames, coalesce(f.frames, 0) AS fine_frames, coalesce(x.frames, 0) AS examined_frames, c.ranges AS coarse_ranges, x.ranges AS examined_ranges,
  coalesce(units, 0) AS candidate_operation_units, coalesce(merges, 0) AS approximate_merge_intervals
FROM (SELECT DISTINCT source_id FROM runs) s LEFT JOIN coarse_r c USING (source_id) LEFT JOIN fine_r f USING (source_id) LEFT JOIN examined_r x USING (source_id) LEFT JOIN u USING (source_id) LEFT JOIN m USING (source_id)""")
def agg_coverage(spark, d):
    out = layers.coverage(_ledger(spark, d))
    spans = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",").alias(c)
    return out.select("source_id", "coarse_frames", "fine_frames", "examined_frames", spans("coarse_ranges"), spans("examined_ranges"), "candidate_operation_units", "approximate_merge_intervals")


@query(f"""WITH RECURSIVE {LEDGER}, {STRICT}, x AS (SELECT *, row_number() OVER () AS i FROM (SELECT DISTINCT * FROM strict)), l AS (SELECT i, x.source_id, f.frame_no, f.time_s FROM x LEFT JOIN frames f ON f.source_id = x.source_id AND list_contains(x.near, f.frame_no))
SELECT x.source_id, count(DISTINCT x.i) AS findings, count(DISTINCT frame_no) AS suggested, floor(min(time_s))::BIGINT AS first_second, floor(max(time_s))::BIGINT AS last_second FROM x JOIN l USING (i) GROUP BY x.source_id""")
def agg_summary(spark, d):
    led = _ledger(spark, d)
    out = audit.summary(audit.located(audit.strict(led), led.frames))
    second = lambda c, n: F.floor(c).cast("long").alias(n)
    return out.select("source_id", "findings", F.size("suggested_frames").cast("long").alias("suggested"), second("start_time", "first_second"), second("end_time", "last_second"))


# --- reviews, snapshots ----------------------------------------------------------------

_FIRST = "first AS (SELECT source_id, k AS kf FROM runs WHERE frame_no = 0)"
_LINES = """sections AS (
  SELECT source_id, 'frames' AS section, frame_no // 10000 AS block, lpad(frame_no::VARCHAR, 19, '0') AS key, concat_ws('|', frame_no, digest, exact_start) AS line FROM runs
  UNION ALL SELECT source_id, 'steps', 0, id, concat_ws('|', id, start_frame, end_frame, status, coalesce(author, '\\N'), array_to_string(evidence, ','), array_to_string(uncertainties, ',')) FROM steps
  UNION ALL SELECT source_id, 'issues', 0, id, concat_ws('|', id, frame_no, frame_no, status, 'q', array_to_string(step_ids, ','), CASE WHEN k < 20 THEN 'evidence' WHEN k < 30 THEN 'withdrawn' ELSE '\\N' END) FROM issues
  UNION ALL SELECT source_id, 'coverage', frame_no // 10000, lpad(frame_no::VARCHAR, 19, '0'), concat_ws('|', frame_no, classification, reviewer, array_to_string(step_ids, ','), array_to_string(issue_ids, ','), fa) FROM coverage
  UNION ALL SELECT c.source_id, 'assets', 0, c.id, concat_ws('|', c.id, coalesce(a.frame_no::VARCHAR, '\\N'), coalesce(a.kind, '\\N'), coalesce(a.sha, '\\N'), coalesce(a.parent_id, '\\N')) FROM (
    SELECT source_id, unnest(evidence) AS id FROM steps UNION SELECT source_id, fa FROM coverage UNION SELECT source_id, fid FROM issues WHERE k < 20) c LEFT JOIN assets a ON a.source_id = c.source_id AND a.id = c.id
)"""
_INTERVAL_LINES = """SELECT source_id, 'intervals' AS section, 0 AS block, id AS key, concat_ws('|', id, start_frame, end_frame, disposition, merge, fine_status, 'ann', array_to_string(step_ids, ','), array_to_string(issue_ids, ','), CASE WHEN fa = fz THEN fa ELSE fa || ',' || fz END) AS line FROM intervals"""


def _hashed(name: str, lines: str) -> str:
    return f"""{name}_b AS (SELECT source_id, section, block, sha256(string_agg(line, chr(10) ORDER BY key, line)) AS h FROM ({lines}) GROUP BY source_id, section, block),
{name} AS (SELECT source_id, sha256(string_agg(section || ':' || block || ':' || h, chr(10) ORDER BY section, block)) AS snapshot FROM {name}_b GROUP BY source_id)"""


_STRICT_SNAPSHOT = _LINES + ", " + _hashed("snap", "SELECT * FROM sections")
_CHECK_LINES = """SELECT c.source_id, 'checks' AS section, 0 AS block, c.id AS key, concat_ws('|', c.id, interval_id, scope_hash, method, conclusion, 'bob', coalesce((SELECT string_agg(ref, ',' ORDER BY n) FROM cevidence e WHERE e.source_id = c.source_id AND e.id = c.id), ''), array_to_string(resolves, ',')) AS line FROM checks c"""
_LAYER_SNAPSHOT = _STRICT_SNAPSHOT + ", " + _hashed("more", f"{_INTERVAL_LINES} UNION ALL {_CHECK_LINES}") + ", lsnap AS (SELECT source_id, sha256(coalesce(s.snapshot, '') || chr(10) || coalesce(m.snapshot, '')) AS snapshot FROM snap s FULL JOIN more m USING (source_id))"


@query(f"WITH RECURSIVE {LEDGER}, {_STRICT_SNAPSHOT} SELECT * FROM snap")
def id_snapshot_strict(spark, d):
    return idn.strict_snapshot(_ledger(spark, d))


@query(f"WITH RECURSIVE {LEDGER}, {COARSE}, {SAMPLE}, {CHECKS}, {_LAYER_SNAPSHOT} SELECT * FROM lsnap")
def id_snapshot_layered(spark, d):
    led = _ledger(spark, d)
    return idn.layered_snapshot(led, _checks(led))


def _context(led):
    return led.frames.select("source_id").distinct().select("source_id", F.lit("why").alias("question"), F.lit("all").alias("scope"), F.array(F.lit("lang-1")).alias("used_language_source_ids"), F.lit("go on").alias("next_action"))


_DELIVERY = _LINES + ", " + _hashed("dsnap", f"SELECT * FROM sections WHERE section IN ('steps', 'issues') UNION ALL {_INTERVAL_LINES} UNION ALL SELECT DISTINCT source_id, 'context', 0, 'context', 'why|all|lang-1' FROM runs")


@query(f"WITH RECURSIVE {LEDGER}, {_DELIVERY} SELECT * FROM dsnap")
def id_snapshot_delivery(spark, d):
    led = _ledger(spark, d)
    return idn.delivery_snapshot(led, _context(led))


def _reviews(led, snapshots, extra):
    """One review per source but some; whose, how independent and how current follows from its first frame."""
    k = F.col("k")
    first = led.frames.where("frame_no = 0").select("source_id", "k").where("k < 90")
    shown = led.states.where("k0 < 50").groupBy("source_id").agg(F.array_sort(F.collect_list(F.format_string("f%09d", "start_frame"))).alias("evidence"))
    rows = first.join(snapshots, "source_id").join(shown, "source_id", "left").join(extra, "source_id", "left")
    return rows.select(
        "source_id", F.lit("V1").alias("id"), F.when(k < 50, "bob").otherwise("cat").alias("reviewer"), F.when(k < 70, "independent").otherwise("self_review").alias("independence"), F.when(k < 80, F.col("snapshot")).otherwise("old").alias("snapshot"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.when(k < 10, F.array(F.lit("I999999999"))).otherwise(F.array().cast("array<string>")).alias("issue_ids"), F.array(F.lit("read_image#0")).alias("tool_trace_refs"),
        F.when(k < 60, "no_additional_omissions_found").otherwise("incomplete").alias("conclusion"), F.lit(1).alias("recorded_at"), *(c for c in extra.columns if c != "source_id"),
    )


def _review_sql(snapshot: str, authors: str, more: str) -> str:
    """Findings of reviews: those both modes share, then ``more``."""
    return f"""reviews AS (
  SELECT f.source_id, CASE WHEN kf < 50 THEN 'bob' ELSE 'cat' END AS reviewer, kf, kf < 80 AS fresh, coalesce((SELECT list({_id("f", "start_frame")} ORDER BY start_frame) FROM st WHERE st.source_id = f.source_id AND k0 < 50), []) AS evidence FROM first f JOIN {snapshot} USING (source_id) WHERE kf < 90
), cur AS (SELECT * FROM reviews WHERE fresh),
rcites AS (SELECT source_id, 'V1' AS reference, unnest(evidence) AS id, []::BIGINT[] AS near FROM cur),
authors AS ({authors}),
review AS (
  SELECT DISTINCT source_id, 'omission_review_missing' AS code, NULL AS reference, []::BIGINT[] AS near FROM runs r WHERE NOT EXISTS (SELECT 1 FROM reviews v WHERE v.source_id = r.source_id)
  UNION ALL SELECT source_id, 'omission_review_stale', 'V1', [] FROM reviews WHERE NOT fresh
  UNION ALL SELECT source_id, 'reviewer_not_independent', 'V1', [] FROM cur c WHERE kf >= 70 OR EXISTS (SELECT 1 FROM authors a WHERE a.source_id = c.source_id AND a.author = c.reviewer)
  UNION ALL {_cited("rcites")}
  UNION ALL SELECT source_id, 'review_trace_unlinked', 'V1', [] FROM cur c WHERE NOT EXISTS (SELECT 1 FROM vv WHERE vv.source_id = c.source_id AND vv.actor = c.reviewer AND list_contains(c.evidence, vv.asset_id) AND vv.trace = 'read_image#0')
  UNION ALL SELECT source_id, 'review_issue_unresolved', 'I999999999', [] FROM cur WHERE kf < 10
  UNION ALL SELECT source_id, 'review_not_complete', 'V1', [] FROM cur WHERE kf >= 60
  UNION ALL {more}
)"""


_STRICT_MORE = """SELECT c.source_id, 'review_scope_incomplete', 'V1', list(s.exact_start ORDER BY s.exact_start) FROM cur c JOIN st s ON s.source_id = c.source_id WHERE s.k0 >= 95 GROUP BY c.source_id
  UNION ALL SELECT c.source_id, 'reviewer_view_missing', s.exact_start::VARCHAR, [s.exact_start - 1, s.exact_start, least(s.exact_start + 1, s.end_frame), s.end_frame, s.end_frame + 1] FROM cur c JOIN st s ON s.source_id = c.source_id
    WHERE NOT EXISTS (SELECT 1 FROM vv JOIN runs r ON r.source_id = vv.source_id AND r.frame_no = vv.frame_no WHERE vv.source_id = c.source_id AND vv.actor = c.reviewer AND vv.kind = 'full' AND vv.presentation = 'native' AND list_contains(c.evidence, vv.asset_id) AND r.exact_start = s.exact_start)"""


@query(f"WITH RECURSIVE {LEDGER}, {_FIRST}, {_STRICT_SNAPSHOT}, {_review_sql('snap', 'SELECT source_id, author FROM steps UNION SELECT source_id, reviewer FROM coverage', _STRICT_MORE)} {_SHOW} review")
def audit_strict_review(spark, d):
    led = _ledger(spark, d)
    snapshots = staged(idn.strict_snapshot(led), "snapshots")
    checked = led.states.groupBy("source_id").agg(F.collect_list(F.when(F.col("k0") < 95, F.col("exact_start"))).alias("checked_state_frames"))
    return _shown(audit.strict_review(led, _reviews(led, snapshots, checked), snapshots))


# the regions of full images are whole frames, so one of the same run covers a role's image
_LAYER_MORE = """SELECT source_id, 'review_scope_incomplete', 'V1', [] FROM cur c WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.source_id = c.source_id AND i.merge = 'none')
  UNION ALL SELECT source_id, 'reviewer_view_missing', id, near FROM short WHERE bad
  UNION ALL SELECT source_id, 'reviewer_fine_view_missing', id, list(DISTINCT frame_no ORDER BY frame_no) FROM wanted GROUP BY source_id, id HAVING bool_or(NOT ok)"""
_LAYER_VIEWS = """, rseen AS (
  SELECT DISTINCT c.source_id, r.exact_start, vv.presentation = 'native' AS native FROM cur c JOIN vv ON vv.source_id = c.source_id AND vv.actor = c.reviewer AND vv.kind = 'full' AND list_contains(c.evidence, vv.asset_id) JOIN runs r ON r.source_id = vv.source_id AND r.frame_no = vv.frame_no
), due AS (SELECT n.*, CASE WHEN required THEN frames ELSE [] END AS targets FROM need n JOIN cur USING (source_id)),
asked AS (SELECT source_id, id, unnest([start_frame, end_frame]) AS n, false AS native FROM due UNION ALL SELECT source_id, id, unnest(targets), true FROM due),
blind AS (SELECT DISTINCT a.source_id, a.id FROM asked a LEFT JOIN runs r ON r.source_id = a.source_id AND r.frame_no = a.n WHERE NOT EXISTS (SELECT 1 FROM rseen s WHERE s.source_id = a.source_id AND s.exact_start = r.exact_start AND (s.native OR NOT a.native))),
short AS (SELECT d.source_id, d.id, list_distinct(list_concat([start_frame, end_frame], targets)) AS raw, list_concat(list_distinct_ordered, []) AS near, b.id IS NOT NULL AS bad FROM (SELECT *, list_concat(CASE WHEN start_frame = end_frame THEN [start_frame] ELSE [start_frame, end_frame] END, [x for x in targets if x <> start_frame and x <> end_frame]) AS list_distinct_ordered FROM due) d LEFT JOIN blind b ON b.source_id = d.source_id AND b.id = d.id),
rolenames AS (SELECT DISTINCT i.source_id, i.id, unnest([s.fa, s.fz]) AS ref FROM (SELECT source_id, id, unnest(step_ids) AS step_id FROM intervals) i JOIN steps s ON s.source_id = i.source_id AND s.id = i.step_id WHERE s.roles),
wanted AS (
  SELECT x.source_id, x.id, a.frame_no, EXISTS (SELECT 1 FROM rseen s WHERE s.source_id = x.source_id AND s.native AND s.exact_start = r.exact_start) AS ok
  FROM rolenames x JOIN cur USING (source_id) JOIN assets a ON a.source_id = x.source_id AND a.id = x.ref JOIN runs r ON r.source_id = a.source_id AND r.frame_no = a.frame_no
)"""


def _with_views(sql: str) -> str:
    """The review's CTEs with those of the layered views before its findings."""
    return sql.replace(", []) AS evidence FROM first f", ", []) AS evidence FROM first f").replace("rcites AS", _LAYER_VIEWS[2:] + ",\nrcites AS")


@query(f"WITH RECURSIVE {LEDGER}, {_FIRST}, {COARSE}, {SAMPLE}, {CHECKS}, {_LAYER_SNAPSHOT}, {_with_views(_review_sql('lsnap', 'SELECT source_id, author FROM steps UNION SELECT source_id, $$ann$$ FROM intervals', _LAYER_MORE))} {_SHOW} review")
def audit_layer_review(spark, d):
    led = _ledger(spark, d)
    snapshots = staged(idn.layered_snapshot(led, _checks(led)), "snapshots")
    checked = led.intervals.where("merge <> 'none'").groupBy("source_id").agg(F.collect_list("id").alias("checked_interval_ids"))
    reviews = _reviews(led, snapshots, checked).withColumn("checked_interval_ids", F.coalesce("checked_interval_ids", F.array().cast("array<string>")))
    return _shown(layers.layered_review(led, reviews, snapshots))


@query(f"""WITH RECURSIVE {LEDGER}, {_FIRST}, {_DELIVERY} SELECT source_id, kf >= 80 AS stale, CASE WHEN kf < 10 THEN 'evidence_changed' WHEN kf >= 80 THEN 'stale' WHEN kf >= 60 THEN 'record_invalid' ELSE 'current' END AS freshness FROM first JOIN dsnap USING (source_id)""")
def id_fresh(spark, d):
    led = _ledger(spark, d)
    snapshots = staged(idn.delivery_snapshot(led, _context(led)), "snapshots")
    k = F.col("k")
    kept = led.frames.where("frame_no = 0").select("source_id", "k").join(snapshots, "source_id").withColumn("snapshot", F.when(k < 80, F.col("snapshot")).otherwise("old"))
    told = idn.stale(kept, snapshots)
    return told.select("source_id", "stale", idn.freshness(k < 10, F.when(F.col("stale"), "old").otherwise("now"), F.lit("now"), k < 60).alias("freshness"))
