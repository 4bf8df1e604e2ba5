"""Session settings and the helpers that decide where intermediate data lives."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "chirrup", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in ``spark.checkpoint.dir``.

    Where it names none: a fixed folder in local mode, else one beside the warehouse's tables.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        local = spark.sparkContext.master.startswith("local")
        configured = "file:///tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str = "rows") -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "rows") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and go on from the written rows.

    Used where several consumers must see the very same rows (range-partition
    boundaries are sampled) and to cut the lineage of iterative jobs. Unlike a
    cache, it survives the loss of executors; unlike a checkpoint, later steps read
    only the columns they use and push their filters down.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go when the job has ended, not when the driver happens to collect its garbage.

    For long rows of jobs that go on from written or persisted rows; Spark repeats a stage whose files are asked for again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
