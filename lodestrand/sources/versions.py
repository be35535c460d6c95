"""Versions of a stored table set behind one pointer: readers see a whole version or the one before it.

A version is a small JSON manifest that names the folders it is made of. Folders are written
first; then the manifest is written aside and renamed to its number, which fails if another
writer has taken the number. What a killed write leaves is named by no manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to follow."""


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step; False, and nothing done, if the target is there."""
    jvm, conf, at, fs = _hadoop(spark, target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), fs.makeQualified(at), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    _, _, at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    _, _, at, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _read(spark: SparkSession, path: str) -> str:
    jvm, _, at, fs = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    _, _, at, fs = _hadoop(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in listed(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith((".", "_"))]


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """The latest version, or the one asked for, and its manifest; 0 and an empty one before the first."""
    found = versions(spark, path)
    if not found:
        return 0, {}
    version = found[-1] if version is None else version
    return version, json.loads(_read(spark, f"{path}/_versions/{version:012d}.json"))


def publish(spark: SparkSession, path: str, after: int, manifest: dict) -> int:
    """Make a manifest the version that follows `after`; Conflict if that one is there already."""
    aside = f"{path}/_versions/.{uuid.uuid4().hex}"
    _write(spark, aside, json.dumps(manifest, sort_keys=True))
    if not move(spark, aside, f"{path}/_versions/{after + 1:012d}.json"):
        remove(spark, aside)
        raise Conflict(f"version {after + 1} of {path} is there already")
    return after + 1


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete folders that none of the last `keep` versions names, and the versions before those; no write may be under way."""
    found = versions(spark, path)
    kept = found[-keep:]
    named = {folder for v in kept for folder in current(spark, path, v)[1].get("folders", [])}
    gone = [n for n in listed(spark, path) if n != "_versions" and n not in named]
    for n in gone:
        remove(spark, f"{path}/{n}")
    for n in listed(spark, f"{path}/_versions"):
        if n.startswith(".") or int(n.removesuffix(".json")) not in kept:
            remove(spark, f"{path}/_versions/{n}")
    return gone
