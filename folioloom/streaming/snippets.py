"""Extraction as a stream: snippets as files arrive, each answered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioloom.operators.checkpoint import KEY
from folioloom.sources.store import literal


def stream_snippets(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Snippets from Parquet files as they arrive, so many files a batch if told."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(literal(path))


def extract_stream(snippets: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, log: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Each micro-batch's new snippets through ``work``: rows to ``out`` and their keys to ``log``, each in a folder of the batch's number.

    Which snippets came before is state that Spark keeps with the checkpoint, by key, so no batch reads the log. A batch that broke off is run
    again by Spark with the same snippets and overwrites its own folders; keys are written after rows, so rows count once their key is there. ``after`` is called
    once a batch is whole.
    """

    def one(batch: DataFrame, number: int) -> None:
        todo = batch.persist()
        try:
            if todo.isEmpty():  # all came before
                return
            work(todo).write.mode("overwrite").parquet(f"{out}/batch={number}")
            todo.select(*KEY).write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            todo.unpersist()
        if after:
            after(number)

    return snippets.dropDuplicates(KEY).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
