"""What the machine offers: modules and programs that optional connectors need."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import shutil
import sys

#: Distributions with the first version and the first one that is too new, and programs; fixed values.
MODULES = {"numpy": ((2,), (3,)), "pyarrow": ((15,), None), "pandas": ((2,), None), "pyspark": ((4,), (5,))}
PROGRAMS = ("java", "ffmpeg", "ffprobe")


def _release(version: str) -> tuple[int, ...]:
    out = []
    for part in version.split("."):
        if not part.isdigit():
            break
        out.append(int(part))
    return tuple(out)


def module(name: str, least: tuple[int, ...], below: tuple[int, ...] | None) -> dict:
    """Whether a module is there in a version that will do."""
    if importlib.util.find_spec(name) is None:
        return {"name": name, "found": False, "ok": False, "version": None}
    version = importlib.metadata.version(name)
    release = _release(version)
    return {"name": name, "found": True, "ok": release >= least and (below is None or release < below), "version": version}


def diagnose() -> dict:
    """All checks; ``ok`` says that corpora and ledgers can be processed, ``media`` that media can be decoded as well."""
    modules = [module(n, *bounds) for n, bounds in MODULES.items()]
    programs = {p: shutil.which(p) for p in PROGRAMS}
    return {"python": sys.version.split()[0], "modules": modules, "programs": programs, "ok": all(m["ok"] for m in modules) and programs["java"] is not None, "media": programs["ffmpeg"] is not None and programs["ffprobe"] is not None}
