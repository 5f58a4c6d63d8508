"""Results that are kept under the digest of what declares them, and archives of published folders.

A result is published in one rename, so a reader sees a whole one or none, and of several writers of one result the
first wins. Archives are made and opened by the driver, file by file, from and to folders that it can reach.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Callable
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from warpline.session import shared_folder
from warpline.sources.artifacts import exists
from warpline.sources.sinks import publish


def canonical(declaration: object) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities raise."""
    return json.dumps(declaration, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(declaration: object) -> str:
    return hashlib.sha256(canonical(declaration).encode()).hexdigest()


def kept(spark: SparkSession, declaration: object, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The stored result of a declaration; it is built and stored if there is none.

    The declaration holds all that the result depends on: the operation, its parameters and the digests of its inputs.
    """
    path = f"{(root or shared_folder(spark)).rstrip('/')}/result-{digest(declaration)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        try:
            publish(build(), path)
        except FileExistsError:  # another writer was first
            pass
    return spark.read.parquet(path)


def archived(folder: str | Path, archive: str | Path, members: list[str] | None = None) -> list[tuple[str, int, str]]:
    """Write the files below a folder to a ZIP with a manifest, in the order of their names; (path, size, sha256) of each."""
    base, listed = Path(folder), []
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in base.rglob("*") if x.is_file()):
            name = p.relative_to(base).as_posix()
            if members is not None and name not in members:
                continue
            h = hashlib.sha256()
            with p.open("rb") as source, z.open(name, "w", force_zip64=True) as target:
                while block := source.read(1 << 20):
                    h.update(block)
                    target.write(block)
            listed.append((name, p.stat().st_size, h.hexdigest()))
        z.writestr("MANIFEST.json", canonical([{"path": a, "size_bytes": b, "sha256": c} for a, b, c in listed]))
    return listed


def extracted(archive: str | Path, folder: str | Path) -> list[str]:
    """Open an archive below a folder: names that lead out of it, links, and files that differ from the manifest raise, before any is written."""
    base = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        wanted = {m["path"]: m for m in json.loads(z.read("MANIFEST.json"))}
        names = [i for i in z.infolist() if i.filename != "MANIFEST.json" and not i.is_dir()]
        for i in names:
            parts = PurePosixPath(i.filename.replace("\\", "/")).parts
            if i.filename.startswith(("/", "\\")) or ".." in parts or (parts and ":" in parts[0]) or (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"{i.filename} leads out of the folder")
        if {i.filename for i in names} != set(wanted):
            raise ValueError("the archive and its manifest hold different files")
        for i in names:
            h = hashlib.sha256()
            with z.open(i) as source:
                while block := source.read(1 << 20):
                    h.update(block)
            if h.hexdigest() != wanted[i.filename]["sha256"]:
                raise ValueError(f"{i.filename} isn't the file that was archived")
        for i in names:
            target = base / i.filename
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(i) as source, target.open("wb") as out:
                while block := source.read(1 << 20):
                    out.write(block)
    return sorted(wanted)
