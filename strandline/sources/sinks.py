"""Sinks: ordered JSON lines, table exports, published generations, image layouts and crops."""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import asset_id, crop_id

MANIFEST, PENDING, HANDOFF = "export-manifest.json", "export.pending.json", "handoff.md"
PREVIOUS = ".previous"


def frames_jsonl(frames: DataFrame, path: str) -> None:
    """Frames as JSON lines in order of source and ordinal: ranges of both, sorted, file by file."""
    frames.orderBy("source_id", "frame_no").write.json(path)


def export_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder per table, partitioned by source so that one ledger reads its own files only."""
    for name, rows in tables.items():
        rows.write.partitionBy("source_id").format(kind).save(f"{path}/{name}")


def _sha256(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def manifest_of(folder: Path, names: list[str], generation: str) -> dict:
    """Names, sizes and hashes of a complete generation."""
    return {"state": "complete", "generation": generation, "files": {n: {"size": (folder / n).stat().st_size, "sha256": _sha256(folder / n)} for n in sorted(names)}}


def blocked(work: Path) -> str | None:
    """Why nothing may be published: an unfinished publication, or a handoff that was edited by hand."""
    work = Path(work)
    if (work / PENDING).exists():
        return "an export is pending"
    handoff = work / HANDOFF
    if handoff.exists():
        try:
            told = json.loads((work / MANIFEST).read_text(encoding="utf-8"))["files"][HANDOFF]["sha256"]
        except (OSError, ValueError, KeyError, TypeError):
            return "the handoff is not from an export"
        if told != _sha256(handoff):
            return "the handoff was edited"
    return None


def publish(work: Path, generation: str, files: dict[str, bytes | str]) -> dict:
    """Publish small files as one generation: all of them, or as before.

    They are written beside their targets, the old ones kept until the manifest, the last, is
    in place; an error in between puts the old ones back. The pending marker is exclusive, and
    stays only if the process dies.
    """
    work = Path(work)
    if why := blocked(work):
        raise RuntimeError(f"not published: {why}")
    stage, old = work / f".export-{generation}", work / f".export-{generation}{PREVIOUS}"
    stage.mkdir(parents=True)
    try:
        for name, body in files.items():
            (stage / name).write_bytes(body.encode() if isinstance(body, str) else body)
        manifest = manifest_of(stage, list(files), generation)
        (stage / MANIFEST).write_text(json.dumps(manifest, indent=1, sort_keys=True), encoding="utf-8")
        with (work / PENDING).open("x", encoding="utf-8") as f:  # fails if another one publishes
            json.dump({"generation": generation, "files": sorted(files)}, f)
        old.mkdir()
        done = []
        try:
            for name in [*files, MANIFEST]:
                if (work / name).exists():
                    shutil.copy2(work / name, old / name)
                done.append(name)
                (stage / name).replace(work / name)
        except BaseException:
            for name in done:
                if (old / name).exists():
                    (old / name).replace(work / name)
                else:
                    (work / name).unlink(missing_ok=True)
            raise
        finally:
            (work / PENDING).unlink()
        return manifest
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)


def verify(work: Path) -> list[str]:
    """What is wrong with the published generation; nothing if it is whole."""
    work = Path(work)
    if (work / PENDING).exists():
        return ["pending"]
    try:
        manifest = json.loads((work / MANIFEST).read_text(encoding="utf-8"))
        files = manifest["files"]
    except (OSError, ValueError, KeyError):
        return ["manifest"]
    return [n for n, f in files.items() if not (work / n).is_file() or (work / n).stat().st_size != f["size"] or _sha256(work / n) != f["sha256"]]


def extracted(requested: DataFrame, frames: DataFrame, decoded: DataFrame) -> DataFrame:
    """Requested frames with their asset id and whether the decoded image has the indexed digest.

    ``requested``: source_id, frame_no; ``decoded``: source_id, frame_no, digest. A frame that is not
    computed, or was not decoded, is not verified.
    """
    want = requested.select("source_id", "frame_no").distinct().join(frames.select("source_id", "frame_no", "digest"), ["source_id", "frame_no"], "left")
    got = decoded.select("source_id", "frame_no", F.col("digest").alias("__got"))
    return want.join(got, ["source_id", "frame_no"], "left").select("source_id", "frame_no", asset_id(F.col("frame_no")).alias("asset_id"), F.coalesce(F.col("digest") == F.col("__got"), F.lit(False)).alias("verified"))


def crop_assets(crops: DataFrame, assets: DataFrame, frames: DataFrame) -> DataFrame:
    """Crops as assets: id, parent, frame and box, with ``problem`` where the parent is no full image or the box not inside it.

    ``crops``: source_id, asset_id, box array<int> (x0, y0, x1, y1).
    """
    a = assets.select("source_id", F.col("id").alias("asset_id"), "frame_no", "kind")
    j = crops.join(a, ["source_id", "asset_id"], "left").join(frames.select("source_id", "frame_no", "width", "height"), ["source_id", "frame_no"], "left")
    x0, y0, x1, y1 = (F.get("box", F.lit(i)) for i in range(4))
    inside = (F.size("box") == 4) & (x0 >= 0) & (x0 < x1) & (x1 <= F.col("width")) & (y0 >= 0) & (y0 < y1) & (y1 <= F.col("height"))
    problem = F.when(F.col("kind").isNull(), "unknown_asset").when(F.col("kind") != "full", "not_a_full_image").when(~F.coalesce(inside, F.lit(False)), "outside")
    return j.select("source_id", crop_id(F.col("asset_id"), F.col("box")).alias("id"), "frame_no", F.lit("crop").alias("kind"), F.col("asset_id").alias("parent_id"), F.col("box").alias("crop"), problem.alias("problem"))


def crop_pixels(images: DataFrame) -> DataFrame:
    """``images`` (width, height, pixels: RGB bytes in rows, box) with the pixels of the box only."""
    names = images.columns
    schema = images.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                x0, y0, x1, y1 = r["box"]
                whole = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
                r["pixels"], r["width"], r["height"] = whole[y0:y1, x0:x1].tobytes(), x1 - x0, y1 - y0
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(n) for n in names]))

    return images.mapInArrow(run, schema)


#: Pixels above each panel of a sheet for its caption; fixed value.
CAPTION = 28


def sheet_layout(panels: DataFrame, thumb_width: int = 480, columns: int = 4) -> DataFrame:
    """Where each panel (source_id, sheet, frame_no, width, height) goes: row by row in order of frames.

    Panels shrink to ``thumb_width``, never grow; a sheet's rows are as tall as its tallest panel
    with caption; a sheet with few panels has as many columns as panels.
    """
    if thumb_width < 64 or columns < 1:
        raise ValueError("thumb_width must be 64 at least and columns positive")
    by = W.partitionBy("source_id", "sheet")
    rows = panels.dropDuplicates(["source_id", "sheet", "frame_no"])
    wide = F.least(F.lit(thumb_width), F.col("width"))
    rows = rows.withColumn("w", wide).withColumn("h", F.bround(F.col("height") * F.col("w") / F.col("width"), 0).cast("int"))
    rows = rows.withColumns({"i": F.row_number().over(by.orderBy("frame_no")) - 1, "cell": F.max("h").over(by) + CAPTION, "cols": F.least(F.lit(columns), F.count(F.lit(1)).over(by).cast("int"))})
    x, y = (F.col("i") % F.col("cols")) * thumb_width, F.floor(F.col("i") / F.col("cols")).cast("int") * F.col("cell") + CAPTION
    return rows.select("source_id", "sheet", "frame_no", asset_id(F.col("frame_no")).alias("asset_id"), F.array(x, y, x + F.col("w"), y + F.col("h")).alias("box"), F.array("w", "h").alias("display_size"))


def sheet_id(members: Column, thumb_width: int, columns: int) -> Column:
    """Id of a sheet from what it shows and how."""
    return F.concat(F.lit("sheet-"), F.substring(F.sha2(F.concat(F.to_json(members), F.lit(f"|{thumb_width}|{columns}")), 256), 1, 20))
