"""Incremental ingest as streams: new files, late and repeated records, windows, resumable lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacquer.sinks.tables import upsert


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark, which bounds the state that is kept."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, by: list[str]) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time: str, delay: str, gap: str, by: list[str]) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Everything that is there now, then stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, target: str, key: str, checkpoint: str, order: str) -> None:
    """Keeps the latest record of each key in generations below ``target``.

    A batch writes the generation named by its number, so that a batch that is run again
    after a loss overwrites its own output only.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        cols = [c for c in df.columns if c != key]
        latest = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")
        if number > 0:
            latest = upsert(spark.read.parquet(f"{target}/generation={number - 1}"), latest, key)
        latest.write.mode("overwrite").parquet(f"{target}/generation={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumable_lookup(todo: DataFrame, done: DataFrame, key: str, ask) -> DataFrame:
    """Answers for what isn't answered yet; transient failures stay out and are asked again next time."""
    from lacquer.sources.probe import lookup_state

    answers = lookup_state(ask(todo.join(done.select(key), key, "left_anti")))
    return answers.where("outcome = 'final'")
