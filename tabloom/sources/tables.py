"""Scans, sinks and fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.spec import TableSpec


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | TableSpec) -> DataFrame:
    """Header CSV with a declared schema; cells that do not fit become null."""
    struct = schema.struct() if isinstance(schema, TableSpec) else schema
    return spark.read.schema(struct).csv(path, header=True, mode="PERMISSIVE")


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def scan_head_sample(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first rows by an explicit key."""
    return df.orderBy(key).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_chunks(df: DataFrame, path: str, step: int, fmt: str = "parquet") -> None:
    """Files of at most ``step`` rows."""
    writer = df.write.option("maxRecordsPerFile", step)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def chunk_manifest(df: DataFrame, key: str, step: int) -> DataFrame:
    """(chunk, rows, first_id, last_id) by row id."""
    return df.groupBy(F.floor(F.col(key) / F.lit(step)).cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def row_digest(columns: list[str]) -> Column:
    """md5 over all cells as text; a null keeps its place with a mark of its own, marks inside cells are escaped."""
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), "[\u0001-\u0003]", "\u0003$0"), F.lit("\u0002")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *cells))


def table_fingerprint(df: DataFrame, spec: TableSpec | None = None, seed: int | str | None = None) -> DataFrame:
    """(rows, digest_sum, digest_xor, fingerprint): the same for any row order and partitioning.

    The sum is a decimal of 38 digits, given as text: a long would overflow beyond 4 billion rows.
    """
    d = df.select(row_digest(df.columns).alias("d"))
    parts = d.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.conv(F.substring("d", 1, 8), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor(F.conv(F.substring("d", 9, 15), 16, 10).cast("long")), F.lit(0)).alias("digest_xor"))
    head = hashlib.sha256((spec.canonical() if spec else "").encode()).hexdigest()
    text = F.concat_ws(":", F.lit(head), F.lit(str(seed)), *[F.col(c).cast("string") for c in ("rows", "digest_sum", "digest_xor")])
    return parts.withColumn("fingerprint", F.sha2(text, 256))
