"""Progressive delivery: the files of a written table arrive chunk by chunk at a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.validate import mark_violations
from tabloom.sources.runtime import scratch_path
from tabloom.sources.tables import write_chunks
from tabloom.spec import TableSpec


def deliver_chunks(df: DataFrame, path: str, step: int, on_chunk: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Write ``df`` in files of ``step`` rows and stream them one file at a time into ``on_chunk``.

    The callback gets a DataFrame and the batch number; restarts go on after the last finished chunk.
    """
    write_chunks(df, path, step)
    spark = df.sparkSession
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return (
        stream.writeStream.foreachBatch(on_chunk)
        .option("checkpointLocation", scratch_path(spark, "deliver"))
        .trigger(availableNow=True)
        .start()
    )


def stream_violations(stream: DataFrame, spec: TableSpec, as_of: str) -> DataFrame:
    """Row rules on a stream: the same stateless expressions as in batch."""
    return mark_violations(stream, spec, as_of).where(F.size("violations") > 0)
