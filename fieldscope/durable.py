"""Cutting lineage in storage that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a private folder only in a local run where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Folders of tables that ``stored`` and ``folder`` made, by application.
_MADE: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared checkpoint folder, to go with ``clear``."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of all queries so far, once their results are consumed; how many folders there were."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        discard(spark, path)
    return len(made)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there: packed, and by column."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever storage it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """``stored`` for a while: the table goes when the block ends, so what is made of it must be done by then."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is planned in the block go as soon as they are used, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
