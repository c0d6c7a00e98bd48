"""What a session needs: workers that find this package, and a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Workers hold one thread's memory and give back what they free.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Workers that start from now on import this package from where the driver has it.

    On a cluster where the package is installed or sent along this changes nothing.
    """
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))
    return spark


@contextmanager
def worker_env(spark: SparkSession, more: dict[str, str]) -> Iterator[None]:
    """Functions that are planned meanwhile run in workers of their own, with these variables as well."""
    env = ready(spark).sparkContext.environment
    before = {k: env.get(k) for k in more}
    env.update(more)
    try:
        yield
    finally:
        for k, v in before.items():
            env.pop(k) if v is None else env.__setitem__(k, v)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the session's ``spark.checkpoint.dir``, deleted when the driver ends.

    A folder of the machine serves only where none is set and driver and executors are one process (tests).
    """
    made = spark.conf.get("lexigrid.shared.dir", None)
    if made:
        return made
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"{found.rstrip('/') if found else 'file://' + tempfile.mkdtemp(prefix='lexigrid-')}/{context.applicationId}"
    spark.conf.set("lexigrid.shared.dir", made)
    path = context._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


@contextmanager
def own_folder(spark: SparkSession, *needed: DataFrame) -> Iterator[None]:
    """Tables that are stored meanwhile go into a folder of their own, which the next use of this deletes, unless one of
    its ``needed`` DataFrames reads it. For work in steps whose results are written before the next step begins."""
    last, base = spark.conf.get("lexigrid.folder.last", None), shared_dir(spark)
    if last and not any(f"/{last}/" in f for df in needed for f in df.inputFiles()):
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/{last}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    own = uuid.uuid4().hex
    spark.conf.set("lexigrid.folder", own)
    try:
        yield
    finally:
        spark.conf.unset("lexigrid.folder")
        spark.conf.set("lexigrid.folder.last", own)


#: Shuffle files go when the execution that made them ends; a stage that is tried again before makes them anew.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there, and its shuffle files go.

    A lost executor costs at most the tasks that run; no block of the result lives on one machine. ``by``: a column whose
    values have folders of their own, of which filters on it read only what they need and ``discard`` deletes one.
    """
    spark = ready(df.sparkSession)
    folder = spark.conf.get("lexigrid.folder", None)
    path = f"{shared_dir(spark)}/{f'{folder}/' if folder else ''}{name}-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a stored table, or those of one of its folders (``column=value``), that nothing reads any more."""
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not part or top.endswith(f"/{part}"):
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
