"""Rules on a stream by windows of event time: bounds and shares of nulls of every closed window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.operators.coerce import number
from tabloom.sources.runtime import scratch_path
from tabloom.spec import TableSpec


def val_windowed(df: DataFrame, spec: TableSpec, time: str, width: str = "1 hour", delay: str = "1 hour", tolerance: float = 0.0) -> DataFrame:
    """(window_start, field, rule, n_rows, n_bad, ok) per window, numeric field and rule (below_min, above_max, null_fraction).

    The same plan serves a table and a stream. On a stream a window closes when the latest time of the batches before, less ``delay``, has
    passed its end; rows that come for a closed window are left out, and state is kept for open windows only, a few counts for each. Rows without
    a time belong to no window. A null share may exceed the field's ``nullable`` by ``tolerance``.
    """
    timed = df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    counts, cells = [], []
    for i, f in enumerate(spec.fields):
        if not f.numeric or f.name not in df.columns:
            continue
        x = number(df, f.name)
        rules = {"below_min": None if f.min is None else x < F.lit(float(f.min)), "above_max": None if f.max is None else x > F.lit(float(f.max)), "null_fraction": x.isNull()}
        for rule, bad in rules.items():
            if bad is None:
                continue
            counts.append(F.count_if(bad).alias(f"_{i}_{rule}"))
            n = F.col(f"_{i}_{rule}")
            ok = n <= (F.lit(f.nullable + tolerance + 1e-9) * F.col("n_rows") if rule == "null_fraction" else F.lit(0))
            cells.append(F.struct(F.lit(f.name).alias("field"), F.lit(rule).alias("rule"), n.alias("n_bad"), ok.cast("int").alias("ok")))
    if not cells:
        raise ValueError("no numeric field of the specification is in the table")
    per_window = timed.groupBy(F.window("_at", width)).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return per_window.select(F.col("window.start").alias("window_start"), "n_rows", F.explode(F.array(*cells)).alias("c")).select(
        "window_start", "c.field", "c.rule", "n_rows", "c.n_bad", "c.ok")


def closed_windows(stream: DataFrame, spec: TableSpec, time: str, width: str = "1 hour", delay: str = "1 hour", tolerance: float = 0.0) -> DataFrame:
    """Runs the rules over all that the stream holds now and gives the closed windows, each written once to the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, "windows")
    found = val_windowed(stream, spec, time, width, delay, tolerance)
    query = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "windows-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
