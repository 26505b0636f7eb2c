"""Named models in a shared folder: versions with a manifest, published at once and checked on loading.

``models/name/v1``, ``v2``, ... each hold a saved segmenter and a manifest with the
SHA-256 of its files.  A version is written beside its place and renamed into it, so
readers see all of it or nothing; where a store cannot do that, the manifest tells a
torn version apart, and it is refused.  Models saved straight into ``models/name`` load
as well, and settings of earlier versions are brought up to date step by step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import forest

MANIFEST = "manifest.json"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of the files of a folder, by their path below it; files are read by the tasks."""
    at, system = _at(spark, folder)
    root = system.makeQualified(at).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("d")).collect()
    found = {r["path"].split(root, 1)[1].lstrip("/"): r["d"] for r in files}
    found.pop(MANIFEST, None)
    return found


def versions(spark: SparkSession, models: str, name: str) -> list[int]:
    """Numbers of the published versions of a model."""
    at, system = _at(spark, f"{models}/{name}")
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def publish(made: forest.Segmenter, models: str, name: str) -> int:
    """Save a segmenter as the next version of a named model; its number.  Of two that publish at once, one gets the next number."""
    spark = SparkSession.active()
    staged = f"{models}/{name}/.staged-{uuid.uuid4().hex}"
    forest.save(made, staged)
    manifest = json.dumps({"version": forest.VERSION, "files": _digests(spark, staged)}, indent=1)
    at, system = _at(spark, f"{staged}/{MANIFEST}")
    out = system.create(at, False)
    out.write(bytearray(manifest.encode()))
    out.close()
    number = max(versions(spark, models, name), default=0) + 1
    while True:
        place = f"{models}/{name}/v{number}"
        # a folder that has come meanwhile would take the staged one inside
        if not _exists(spark, place) and system.rename(_at(spark, staged)[0], _at(spark, place)[0]):
            return number
        number += 1


def located(spark: SparkSession, models: str | list[str], name: str, version: int | None = None) -> str:
    """Folder of a model: of the version, or else of the newest, in the first folder of models that has it."""
    for root in [models] if isinstance(models, str) else models:
        root = root.rstrip("/")
        there = versions(spark, root, name)
        if there and (version is None or version in there):
            return f"{root}/{name}/v{there[-1] if version is None else version}"
        if not there and version is None and _exists(spark, f"{root}/{name}/config"):
            return f"{root}/{name}"
    raise FileNotFoundError(f"no model {name!r}" + (f" of version {version}" if version else ""))


def check(spark: SparkSession, folder: str) -> None:
    """Raise ValueError unless the files of a version are those of its manifest."""
    rows = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).collect()
    wanted = json.loads(rows[0]["value"])["files"]
    found = _digests(spark, folder)
    wrong = sorted(f for f in wanted.keys() | found.keys() if wanted.get(f) != found.get(f))
    if wrong:
        raise ValueError(f"model in {folder} is torn: {', '.join(wrong[:5])}")


def load(models: str | list[str], name: str, version: int | None = None) -> forest.Segmenter:
    """A published model, checked against its manifest, or one saved straight into its folder."""
    spark = SparkSession.active()
    folder = located(spark, models, name, version)
    if _exists(spark, f"{folder}/{MANIFEST}"):
        check(spark, folder)
    elif folder.rsplit("/", 1)[-1] != name:
        raise ValueError(f"model in {folder} is torn: no manifest")
    return forest.load(folder)
