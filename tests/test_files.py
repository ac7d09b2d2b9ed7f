"""Files in chunks: large ones, unchanged ones, containers by seeking."""

import hashlib
import os
import resource
import struct

from pyspark.sql import functions as F

from strandline.sources import adapters, files


def box(kind, body=b""):
    return struct.pack(">I", 8 + len(body)) + kind + body


MOVIE = box(b"ftyp", b"isom") + box(b"moov", box(b"trak"))
FOREIGN = box(b"ftyp", b"isom") + box(b"moov", box(b"rmra"))


def test_inventory_reads_new_and_changed_files_only(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    body = {"d/a.mp4": MOVIE, "d/sub/b name.mp4": FOREIGN, "d/c.mkv": bytes.fromhex("1A45DFA3") + b"x", "d/empty": b"", "d/t.txt": b"text"}
    for n, b in body.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.inventory(spark, f"file://{tmp_path}/d").collect()}
    assert {n: (r.sha256, r.kind, r.reused) for n, r in got.items()} == {n.rsplit("/", 1)[-1]: (hashlib.sha256(b).hexdigest(), {"a.mp4": "mov", "c.mkv": "matroska"}.get(n.rsplit("/", 1)[-1]), False) for n, b in body.items()}
    known = spark.createDataFrame(list(got.values()), "path string, length long, modificationTime timestamp, sha256 string, kind string, reused boolean")
    (tmp_path / "d/t.txt").write_bytes(b"other")
    (tmp_path / "d/new").write_bytes(b"n")
    os.remove(tmp_path / "d/empty")
    again = {r.path.rsplit("/", 1)[-1]: r for r in files.inventory(spark, f"file://{tmp_path}/d", known).collect()}
    assert {n: r.reused for n, r in again.items()} == {"a.mp4": True, "b name.mp4": True, "c.mkv": True, "t.txt": False, "new": False}
    assert again["t.txt"].sha256 == hashlib.sha256(b"other").hexdigest()
    names = files.named(spark.createDataFrame(list(again.values()), known.schema), f"file://{tmp_path}/d")
    before = files.named(known, f"{tmp_path}/d")
    assert {(r.name, r.state) for r in adapters.compare_inventories(before, names).collect()} == {("a.mp4", "same"), ("sub/b name.mp4", "same"), ("c.mkv", "same"), ("t.txt", "changed"), ("new", "extra"), ("empty", "missing")}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse, so it costs no disk; hashed and walked within a few chunks of memory."""
    size, path = (2 << 30) + (64 << 20), tmp_path / "large.mp4"
    with path.open("wb") as f:
        f.write(box(b"ftyp", b"isom"))
        rest = size - 12 - 16
        f.write(struct.pack(">I4sQ", 1, b"mdat", rest - len(MOVIE[12:]) + 16))
        f.truncate(size)
        f.seek(size - len(MOVIE[12:]))
        f.write(MOVIE[12:])
    want, block = hashlib.sha256(), 1 << 24
    with path.open("rb") as f:
        while b := f.read(block):
            want.update(b)
    row = spark.createDataFrame([(str(path),), (str(tmp_path / "none"),)], "path string")

    def peak(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10] * batch.num_rows, pa.int64())], [*batch.schema.names, "mb"])

    looked = files.examined(row).select("path", "n_bytes", "sha256", "mov_problem")
    told = {r.path: r for r in looked.mapInArrow(peak, "path string, n_bytes long, sha256 string, mov_problem string, mb long").collect()}
    large = told[str(path)]
    assert (large.n_bytes, large.sha256, large.mov_problem) == (size, want.hexdigest(), None) and large.mb < 400
    assert told[str(tmp_path / "none")].n_bytes is None
    assert files.inventory(spark, f"file://{tmp_path}").where(F.col("kind") == "mov").count() == 1


def test_boxes_are_walked_by_ranged_reads():
    reads = []

    def read(at, n):
        reads.append(n)
        return whole[at : at + n]

    for whole, why in ((MOVIE, None), (FOREIGN, "reference or compressed movie"), (box(b"ftyp"), "no movie metadata"), (MOVIE[:-1], "box outside its parent"), (MOVIE + b"xx", "malformed or too many boxes")):
        reads.clear()
        assert adapters.mov_problem(read, len(whole)) == why and max(reads) <= 8
    url = lambda flag: box(b"url ", struct.pack(">I", flag))
    dref = lambda n, *refs: box(b"moov", box(b"trak", box(b"dref", struct.pack(">II", 0, n) + b"".join(refs))))
    for whole, why in ((dref(1, url(1)), None), (dref(1, url(0)), "external reference"), (dref(2, url(1)), "reference count"), (dref(0), "reference table")):
        assert adapters.mov_problem(read, len(whole)) == why
