"""Snapshots of a second ledger as evidence of later claims, and deliveries with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_digest, nonblank, safe_path
from ..operators.contracts import IMAGE_ENDINGS, VIEW_TOOLS
from ..operators.identity import freshness


def _sound(v: DataFrame) -> DataFrame:
    """Views of native images by a known tool, with nothing blank."""
    told = nonblank(F.col("actor")) & nonblank(F.col("trace_ref")) & nonblank(F.col("observation"))
    return v.where((F.coalesce("presentation", F.lit("native")) == "native") & F.col("tool").isin(*VIEW_TOOLS) & told)


def view_matches(views: DataFrame, assets: DataFrame, by: list[str]) -> DataFrame:
    """Sound views whose asset, frame and hash are those of ``assets`` (by, asset_id, frame_no, sha256)."""
    a = assets.select(*by, "asset_id", "frame_no", F.col("sha256").alias("asset_sha256")).distinct()
    return _sound(views).join(a, [*by, "asset_id", "frame_no", "asset_sha256"], "left_semi")


def import_problems(wanted: DataFrame, exports: DataFrame, assets: DataFrame, views: DataFrame, frames: DataFrame, files: DataFrame, primary: DataFrame) -> DataFrame:
    """(source_id, id, asset_id, code) of what keeps assets of another export from being imported.

    ``wanted``: source_id, id (of the supplement), export_id, asset_id. ``exports``: export_id,
    state, valid, source_sha256, verified_sha256, pending. ``assets``, ``views``, ``frames``: the
    export's tables, with export_id; ``files``: export_id, path, sha256. ``primary``: source_id, sha256.
    """
    e = exports.select("export_id", "state", "valid", "source_sha256", "verified_sha256", "pending", F.lit(True).alias("__e"))
    a = assets.select("export_id", F.col("id").alias("asset_id"), "frame_no", "kind", "path", "parent_id", F.col("sha256").alias("asset_sha256"))
    n = a.groupBy("export_id", "asset_id").agg(F.count(F.lit(1)).alias("copies"))
    seen = view_matches(views, assets.withColumnRenamed("id", "asset_id"), ["export_id"]).select("export_id", "asset_id").distinct().withColumn("__seen", F.lit(True))
    known = frames.groupBy("export_id", "frame_no").agg(F.count(F.lit(1)).alias("frames"))
    j = wanted.join(e, "export_id", "left").join(primary.select("source_id", F.col("sha256").alias("own")), "source_id", "left").join(n, ["export_id", "asset_id"], "left")
    j = j.join(a.dropDuplicates(["export_id", "asset_id"]), ["export_id", "asset_id"], "left").join(files.select("export_id", "path", F.col("sha256").alias("now")), ["export_id", "path"], "left")
    j = j.join(seen, ["export_id", "asset_id"], "left").join(known, ["export_id", "frame_no"], "left")
    image = F.lit(False)
    for end in IMAGE_ENDINGS:
        image = image | F.endswith(F.lower("path"), F.lit(end))
    full = (F.col("kind") == "full") & (F.col("frame_no") >= 0) & F.col("parent_id").isNull() & is_digest(F.col("asset_sha256"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("unknown_export", F.col("__e")), ("export_pending", ~F.col("pending")), ("export_incomplete", F.col("state") == "complete"), ("export_invalid", F.col("valid") & is_digest(F.col("source_sha256")) & (F.col("source_sha256") == F.col("verified_sha256"))),
        ("not_independent", ~F.col("source_sha256").eqNullSafe(F.col("own"))), ("unknown_or_duplicate_asset", F.col("copies") == 1), ("not_a_full_image", full), ("unsafe_path", safe_path(F.col("path"))), ("not_an_image", image),
        ("file_changed", F.col("now") == F.col("asset_sha256")), ("no_native_view", F.col("__seen")), ("unknown_frame", F.col("frames") == 1),
    ]
    first = F.coalesce(*(F.when(~ok(rule), F.lit(code)) for code, rule in rules))
    return j.withColumn("code", first).where(F.col("code").isNotNull()).select("source_id", "id", "asset_id", "code")


def snapshot_status(entries: DataFrame, packages: DataFrame, files: DataFrame, assets: DataFrame, views: DataFrame) -> DataFrame:
    """(source_id, id, valid) of imported snapshots, judged from their own files only.

    ``entries``: source_id, id, package_sha256 (as registered). ``packages``: source_id, id,
    sha256 (of the package file now), export_generation, review_generation, source_sha256,
    review_source_sha256. ``files``: source_id, id, name, expected, sha256 (now). ``assets`` and
    ``views``: of the snapshot, with supplement id ``id`` and ``asset_id``; views carry package_sha256.
    """
    p = packages.select("source_id", "id", F.col("sha256").alias("__now"), ((F.col("export_generation") == F.col("review_generation")) & (F.col("source_sha256") == F.col("review_source_sha256"))).alias("__same"))
    changed = files.where(~F.col("sha256").eqNullSafe(F.col("expected"))).select("source_id", "id").distinct()
    right = view_matches(views, assets, ["source_id", "id"]).join(entries.select("source_id", "id", "package_sha256"), ["source_id", "id", "package_sha256"], "left_semi")
    keys = ["source_id", "id", "asset_id", "actor", "trace_ref"]
    stray = views.join(right.select(*keys).distinct(), keys, "left_anti").select("source_id", "id").distinct()
    bad = changed.unionByName(stray).distinct().withColumn("__bad", F.lit(True))
    j = entries.join(p, ["source_id", "id"], "left").join(bad, ["source_id", "id"], "left")
    valid = F.coalesce((F.col("__now") == F.col("package_sha256")) & F.col("__same"), F.lit(False)) & F.col("__bad").isNull()
    return j.select("source_id", "id", valid.alias("valid"))


def reference_problems(refs: DataFrame, status: DataFrame, assets: DataFrame, views: DataFrame) -> DataFrame:
    """(source_id, issue_id, code, reference) of follow-up references.

    ``refs``: source_id, issue_id, reviewer, supplement_id, asset_id. The reviewer must have a
    view of their own; views that came with the import do not count.
    """
    told = nonblank(F.col("supplement_id")) & nonblank(F.col("asset_id"))
    s = status.select("source_id", F.col("id").alias("supplement_id"), "valid", F.lit(True).alias("__s"))
    a = assets.select("source_id", F.col("id").alias("supplement_id"), "asset_id", F.lit(True).alias("__a")).distinct()
    v = view_matches(views, assets, ["source_id", "id"]).select("source_id", F.col("id").alias("supplement_id"), "asset_id", F.col("actor").alias("reviewer"), F.lit(True).alias("__v")).distinct()
    j = refs.join(s, ["source_id", "supplement_id"], "left").join(a, ["source_id", "supplement_id", "asset_id"], "left").join(v, ["source_id", "supplement_id", "asset_id", "reviewer"], "left")
    code = (
        F.when(~told, "invalid_supplement_reference").when(F.col("__s").isNull(), "unknown_supplement").when(~F.col("valid"), "invalid_supplement")
        .when(F.col("__a").isNull(), "unknown_supplement_evidence").when(F.col("__v").isNull(), "unreviewed_supplement_evidence")
    )
    reference = F.when(code == "invalid_supplement_reference", F.lit("supplement_refs")).when(code.isin("unknown_supplement", "invalid_supplement"), F.col("supplement_id")).otherwise(F.col("asset_id"))
    return j.withColumns({"code": code, "reference": reference}).where(F.col("code").isNotNull()).select("source_id", "issue_id", "code", "reference")


def context_problems(contexts: DataFrame, languages: DataFrame) -> DataFrame:
    """(source_id, language_id) that delivery contexts say were used but were never imported."""
    used = contexts.select("source_id", F.explode("used_language_source_ids").alias("language_id")).distinct()
    return used.join(languages.select("source_id", F.col("id").alias("language_id")), ["source_id", "language_id"], "left_anti")


def reproduction_problems(new: DataFrame, stored: DataFrame, steps: DataFrame, snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(source_id, id, code) of reproduction checks that must be refused.

    ``new``: source_id, id, step_ids, content_snapshot, artifacts array of (path, sha256);
    ``artifacts``: source_id, path, sha256 of the files that lie in the work folder and are not
    the ledger's own.
    """
    now = snapshots.select("source_id", F.col("snapshot").alias("__now"))
    code = lambda rows, name: rows.select("source_id", "id", F.lit(name).alias("code")).distinct()
    named = new.select("source_id", "id", F.explode("step_ids").alias("step_id")).join(steps.select("source_id", F.col("id").alias("step_id")), ["source_id", "step_id"], "left_anti")
    told = new.select("source_id", "id", F.explode("artifacts").alias("a")).select("source_id", "id", F.col("a.path").alias("path"), F.col("a.sha256").alias("sha256"))
    lost = told.join(artifacts, ["source_id", "path", "sha256"], "left_anti")
    twice = new.groupBy("source_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        code(new.join(stored.select("source_id", "id"), ["source_id", "id"], "left_semi"), "already_recorded").unionByName(code(twice, "already_recorded")).unionByName(code(named, "unknown_step"))
        .unionByName(code(new.join(now, "source_id", "left").where(~F.col("content_snapshot").eqNullSafe(F.col("__now"))), "stale_snapshot")).unionByName(code(lost, "artifact_changed")).distinct()
    )


def reproduction_state(checks: DataFrame, artifacts: DataFrame, snapshots: DataFrame, valid: DataFrame) -> DataFrame:
    """``checks`` with ``freshness``. ``valid``: source_id, valid (of the whole ledger)."""
    told = checks.select("source_id", "id", F.explode("artifacts").alias("a")).select("source_id", "id", F.col("a.path").alias("path"), F.col("a.sha256").alias("sha256"))
    changed = told.join(artifacts, ["source_id", "path", "sha256"], "left_anti").select("source_id", "id").distinct().withColumn("__changed", F.lit(True))
    j = checks.join(changed, ["source_id", "id"], "left").join(snapshots.select("source_id", F.col("snapshot").alias("__now")), "source_id", "left").join(valid.select("source_id", F.col("valid").alias("__valid")), "source_id", "left")
    fresh: Column = freshness(F.col("__changed").isNotNull(), F.col("content_snapshot"), F.col("__now"), F.coalesce("__valid", F.lit(False)))
    return j.withColumn("freshness", fresh).drop("__changed", "__now", "__valid")
