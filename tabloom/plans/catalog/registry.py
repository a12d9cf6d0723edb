"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.sources.runtime import spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table whose rows cost much work each, dealt over the cores if its files are few."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df, key)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all double columns; ``special`` gives single columns another precision."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(F.col(f"`{c}`"), special.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns])


# ---- SQL text of the shared formulas ----------------------------------------------------------


def u(seed, label: str, *ids: str) -> str:
    return share(digits(seed, label, *ids), 1)


def digits(seed, label: str, *ids: str) -> str:
    cells = ", ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"md5(concat_ws(':', '{seed}:{label}', {cells}))"


def share(text: str, start: int, size: int = 13) -> str:
    return f"(CAST('0x' || substr({text}, {start}, {size}) AS BIGINT) / CAST({16 ** size} AS DOUBLE))"


def z(seed, label: str, *ids: str) -> str:
    d = digits(seed, label, *ids)
    return f"(sqrt(-2.0e0 * ln(1.0e0 - {share(d, 1)})) * cos({2.0 * math.pi!r}e0 * {share(d, 14)}))"


def choice(values: list, probs: list | None, draw: str) -> str:
    from tabloom.functions.rng import cumulative

    cum = cumulative(probs if probs else [1.0] * len(values))
    cases = " ".join(f"WHEN {draw} < {edge!r}e0 THEN '{v}'" for v, edge in list(zip(values, cum))[:-1])
    return f"(CASE {cases} ELSE '{values[-1]}' END)"


def uuid(ident: str, namespace: int, name: str) -> str:
    d = f"sha256(concat_ws(':', '{namespace}', CAST({ident} AS VARCHAR), '{name}'))"
    return "concat_ws('-', " + ", ".join(f"substr({d}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def listed(values: list, draw: str) -> str:
    body = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"list_extract({body}, CAST(floor({draw} * {float(len(values))!r}e0) AS INTEGER) + 1)"


def ppf(p: str) -> str:
    from tabloom.functions import special as S

    def poly(cs, x):
        out = f"({cs[0]!r})"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    q = f"({p} - 0.5e0)"
    r = f"({q} * {q})"
    lo, hi = f"sqrt(-2.0e0 * ln({p}))", f"sqrt(-2.0e0 * ln(1.0e0 - {p}))"
    return (
        f"(CASE WHEN {p} < {S.PPF_LOW}e0 THEN {poly(S.PPF_C, lo)} / {poly(S.PPF_D, lo)} "
        f"WHEN {p} > {1 - S.PPF_LOW}e0 THEN -({poly(S.PPF_C, hi)} / {poly(S.PPF_D, hi)}) "
        f"ELSE {poly(S.PPF_A, r)} * {q} / {poly(S.PPF_B, r)} END)"
    )


def average_rank(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0e0)"
