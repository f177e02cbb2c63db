"""Shared scratch space for intermediates that more than one job reads."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What this worker process remembers from one task to the next, by name, and how it is forgotten.
_memories: dict[str, Callable[[], None]] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is run from a source tree."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)


def turn_to(name: str, forget: Callable[[], None] | None = None) -> None:
    """At the start of a task: whatever else a reused worker remembers from tasks of other operators goes.

    `forget` drops what is going to be remembered under `name`. So a worker that serves one stage after the other
    holds the memory of one of them.
    """
    others = [other for other in _memories if other != name]
    for other in others:
        _memories.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    if forget is not None:
        _memories[name] = forget


def scratch_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a folder of our own only in local mode with the setting unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables under one fresh folder of the shared scratch space.

    A stored table cuts the lineage: a lost executor costs the tasks that were running,
    never the jobs that came before.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.folder = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later plan reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
