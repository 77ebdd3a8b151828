"""Versions of a folder: parts are written under a new name, and one small file names those that count.

A commit is a file ``_commits/<number>`` that comes into place by a rename to a name that must be free, so a reader sees the state before or after a
commit and never a part of one. A job that stops before its commit leaves parts that nobody reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the last commit; (0, {}) if there is none."""
    jvm, path, store = _store(spark, folder)
    if not store.exists(path):
        return 0, {}
    numbers = [int(s.getPath().getName()) for s in store.listStatus(path) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    with_number = jvm.org.apache.hadoop.fs.Path(path, f"{max(numbers):012d}")
    stream = store.open(with_number)
    try:
        return max(numbers), json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, content: dict, after: int) -> int:
    """Make ``content`` the state that follows commit ``after``; raises if another commit came first."""
    jvm, path, store = _store(spark, folder)
    store.mkdirs(path)
    draft, final = (jvm.org.apache.hadoop.fs.Path(path, name) for name in (f".{uuid.uuid4().hex}", f"{after + 1:012d}"))
    stream = store.create(draft, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise RuntimeError(f"{folder}: commit {after + 1} is already there")
    return after + 1


def new_version() -> str:
    return f"v-{uuid.uuid4().hex[:16]}"


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders right below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
