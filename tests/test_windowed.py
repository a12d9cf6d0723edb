"""Windowed rules on a stream: closed windows equal the batch, late rows stay out, restarts go on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.spec import TableSpec
from tabloom.streaming.windowed import closed_windows, val_windowed

SPEC = TableSpec.from_dict({"fields": [{"name": "load", "type": "float", "min": 0, "max": 10, "nullable": 0.4}, {"name": "who", "type": "string"}]})
SCHEMA = "at timestamp_ntz, load double, who string"


def row(hour, minute, load):
    return (dt.datetime(2024, 5, 1, hour, minute), load, "x")


def stream_of(spark, tmp_path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def found(df):
    return {(r.window_start.hour, r.rule): (r.n_rows, r.n_bad, r.ok) for r in df.collect()}


FIRST = [row(1, 5, 3.0), row(1, 50, 11.0), row(1, 55, None), row(2, 10, -1.0), row(2, 11, None), row(2, 12, None), (None, 99.0, "x")]


def test_closed_windows_equal_the_batch(spark, tmp_path):
    rows = [*FIRST, row(3, 0, 4.0), row(5, 30, 5.0)]
    got = found(closed_windows(stream_of(spark, tmp_path, rows), SPEC, "at", "1 hour", "30 minutes"))
    whole = found(val_windowed(spark.createDataFrame(rows, SCHEMA), SPEC, "at", "1 hour", "30 minutes"))
    assert got == {k: v for k, v in whole.items() if k[0] <= 4} and (5, "above_max") in whole
    assert got[1, "above_max"] == (3, 1, 0) and got[1, "null_fraction"] == (3, 1, 1) and got[2, "null_fraction"] == (3, 2, 0) and got[2, "below_min"] == (3, 1, 0)


def test_late_rows_stay_out(spark, tmp_path):
    late = [row(1, 20, 50.0), row(4, 40, 50.0), row(9, 0, 1.0)]  # the window of one o'clock is closed by then, that of four is not
    stream = stream_of(spark, tmp_path, [*FIRST, row(4, 30, 5.0)], [row(4, 31, 5.0)], late)
    got = found(closed_windows(stream, SPEC, "at", "1 hour", "30 minutes"))
    assert got[1, "above_max"] == (3, 1, 0) and got[4, "above_max"] == (3, 1, 0)


def test_nothing_and_nothing_numeric(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(None, None, None)])
    assert closed_windows(stream, SPEC, "at").collect() == []
    with pytest.raises(ValueError):
        val_windowed(spark.createDataFrame(FIRST, SCHEMA).select("at", "who"), SPEC, "at")
    both = val_windowed(spark.createDataFrame(FIRST, SCHEMA).withColumn("load", F.col("load").cast("string")), SPEC, "at", tolerance=0.5)
    assert found(both)[2, "null_fraction"] == (3, 2, 1)
