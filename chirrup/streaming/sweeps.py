"""The event log as a stream: a sweep is a micro-batch of landed files.

The transformations are the batch ones; only state, sinks and the per-batch bookkeeping
differ. Each sink is keyed by the batch id, so a batch replayed after a failure overwrites
its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chirrup.plans import live
from chirrup.sources.files import EVENT_SCHEMA


def read_landing(spark: SparkSession, folder: str, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def deduplicated(stream: DataFrame, *, lateness: str | None = None) -> DataFrame:
    """Each record once. Without a lateness the ids are kept for ever; with one they expire."""
    if lateness is None:
        return stream.dropDuplicates(["record_id"])
    return stream.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["record_id"])


def hourly_counts(stream: DataFrame, *, lateness: str | None = None) -> DataFrame:
    """Tumbling hours of creation time, per kind."""
    timed = stream.where(F.col("created_at").isNotNull())
    if lateness:
        timed = timed.withWatermark("created_at", lateness)
    return timed.groupBy(F.window("created_at", "1 hour").alias("w"), live.kind(F.col("source")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("hour"), "kind", "n")


def scored(stream: DataFrame, model) -> DataFrame:
    """A fitted pipeline applied to every arriving record."""
    return model.transform(stream)


def write_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to the event log until all landed files are consumed."""
    return (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_scored(stream: DataFrame, score, folder: str, checkpoint: str) -> StreamingQuery:
    """Every batch as ``score`` returns it, for models that are a relation and join each batch with it."""

    def save(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def write_counts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the current hourly counts: each batch writes the hours it changed."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Latest count of every hour and kind over the batches written so far."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("hour", "kind").agg(F.max_by("n", "batch").alias("n"))


def monitor(
    stream: DataFrame, folder: str, checkpoint: str, *, z: float = live.SPIKE_Z
) -> StreamingQuery:
    """Per batch: hourly increments, a sweep-log row, the totals of all hours, and their spikes.

    The totals of a batch are those of the batch before plus its increments, so a batch reads the
    landed records and one row per hour, however many batches went before. All outputs are keyed by
    the batch, and none is read by the batch that writes it: a replayed batch ends the same.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hours = (
            batch.withColumn("hour_local", F.date_trunc("hour", live.local_time(F.col("created_at"))))
            .groupBy("hour_local", live.kind(F.col("source")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        hours.write.mode("overwrite").parquet(f"{folder}/hours/batch_id={batch_id}")
        written = spark.read.parquet(f"{folder}/hours/batch_id={batch_id}")
        written.agg(F.lit(batch_id).alias("batch"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_records")).write.mode(
            "overwrite"
        ).parquet(f"{folder}/sweeps/sweep={batch_id}")
        totals = written.where(F.col("hour_local").isNotNull()).select("hour_local", "n")
        if batch_id:
            totals = totals.unionByName(hourly_totals(spark, folder, batch_id - 1))
        totals = totals.groupBy("hour_local").agg(F.sum("n").alias("n")).repartition(1)  # a row per hour is one small file; summed in tasks of its own before
        totals.write.mode("overwrite").parquet(_totals(folder, batch_id))
        live.spikes(hourly_totals(spark, folder, batch_id), z=z).write.mode("overwrite").parquet(f"{folder}/spikes/sweep={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    )


def _totals(folder: str, batch_id: int) -> str:
    return f"{folder}/totals/batch_id={batch_id}"


def hourly_totals(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """(hour_local, n): all records of each hour up to and including the batch."""
    return spark.read.parquet(_totals(folder, batch_id))
