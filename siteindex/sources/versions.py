"""Several tables that change together: new versions are written beside the old ones, then a manifest names them in one step.

A manifest is a small file that maps each table to the folder of its version. It appears
under its number only when everything it names has been written; what fails before that
leaves the previous state, and of two changes to one state the later one is refused.
Versions are never altered, so that readers keep what they have begun to read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


class Conflict(RuntimeError):
    """Someone else has changed the tables meanwhile."""


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[int]:
    where, fs = _files(spark, f"{root}/manifests")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def state(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the newest manifest, and each table's folder; 0 and none before the first."""
    known = _manifests(spark, root)
    if not known:
        return 0, {}
    where, fs = _files(spark, f"{root}/manifests/{known[-1]:012}.json")
    stream = fs.open(where)
    try:
        return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def tables(spark: SparkSession, root: str) -> Tables:
    return {name: spark.read.parquet(path) for name, path in state(spark, root)[1].items()}


def commit(spark: SparkSession, root: str, changed: Tables, after: int) -> int:
    """Writes the ``changed`` tables and makes them, with the others as they were, the state that follows ``after``."""
    number, paths = state(spark, root)
    if number != after:
        raise Conflict(f"the tables are at {number}, the change is of {after}")
    made = dict(paths)
    for name, rows in changed.items():
        made[name] = f"{root}/data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(made[name])
    draft, fs = _files(spark, f"{root}/manifests/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(json.dumps(made).encode())
    stream.close()
    final, _ = _files(spark, f"{root}/manifests/{after + 1:012}.json")
    # A rename doesn't replace a file; some file systems say so, others return false.
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"another change of {after} came first")
    return after + 1


def change(spark: SparkSession, root: str, edit: Callable[[Tables], Tables]) -> int:
    """Commits what ``edit`` makes of the current tables; it returns those that change."""
    number, paths = state(spark, root)
    return commit(spark, root, edit({name: spark.read.parquet(path) for name, path in paths.items()}), number)


def discard_old(spark: SparkSession, root: str) -> int:
    """Deletes the versions that the newest manifest doesn't name; how many. Nothing may still read them."""
    _, paths = state(spark, root)
    keep, gone = set(paths.values()), 0
    data, fs = _files(spark, f"{root}/data")
    for name in fs.listStatus(data) if fs.exists(data) else []:
        for version in fs.listStatus(name.getPath()):
            path = f"{root}/data/{name.getPath().getName()}/{version.getPath().getName()}"
            if path not in keep:
                gone += bool(fs.delete(version.getPath(), True))
    return gone
