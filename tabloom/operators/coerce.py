"""Projections that clean and rescale columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.spec import SNAKE_STEPS, TableSpec, snake


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def snake_case_text(c: Column) -> Column:
    """The rename rule over a column of names."""
    out = F.trim(c)
    for pattern, repl in SNAKE_STEPS:
        out = F.regexp_replace(out, pattern, repl.replace("{", "$").replace("}", ""))
    return F.regexp_replace(F.lower(out), "^_+|_+$", "")


# How a number may be written.
NUMBER_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(df: DataFrame, name: str) -> Column:
    """Tolerant double: text that is no number becomes null.

    Text is matched before it is cast: a failing cast raises and swallows an exception per row, which
    makes dirty columns a hundred times slower than clean ones.
    """
    c = F.col(f"`{name}`")
    return F.when(c.rlike(NUMBER_TEXT), c.try_cast("double")) if is_text(df, name) else c.try_cast("double")


def coerce_column(df: DataFrame, name: str, ftype: str) -> Column:
    """Tolerant cast to a specification type; int rounds half to even."""
    c = F.col(f"`{name}`")
    if ftype == "int":
        return F.rint(number(df, name)).try_cast("long")
    if ftype == "float":
        return number(df, name)
    if ftype == "bool":
        if not is_text(df, name):
            return F.when(c.cast("double") == 1, F.lit(1)).when(c.cast("double") == 0, F.lit(0))
        return F.when(F.lower(c).isin("true", "1"), F.lit(1)).when(F.lower(c).isin("false", "0"), F.lit(0))
    if ftype == "datetime":
        return c.try_cast("timestamp_ntz")
    return c


def coerce_to_spec(df: DataFrame, spec: TableSpec) -> DataFrame:
    types = {f.name: f.type for f in spec.fields}
    return df.select(*[coerce_column(df, c, types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def column_moments(df: DataFrame, columns: list[str], stddev=F.stddev_pop) -> DataFrame:
    """One row with ``mean_<c>`` and ``std_<c>``."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[stddev(c).alias(f"std_{c}") for c in columns]
    )


def standardize(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std with nulls read as 0 and a zero std read as 1.

    The moments are scalar subqueries over one aggregate, of ``df`` itself or of ``by``.
    """
    filled = df.withColumns({c: F.coalesce(number(df, c), F.lit(0.0)) for c in columns})
    base = filled if by is None else by.withColumns(
        {c: F.coalesce(number(by, c), F.lit(0.0)) for c in columns}
    )
    moments = column_moments(base, columns)
    return filled.withColumns(
        {
            c: (F.col(c) - moments.select(f"mean_{c}").scalar())
            / F.coalesce(F.nullif(moments.select(f"std_{c}").scalar(), F.lit(0.0)), F.lit(1.0))
            for c in columns
        }
    )


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c), means.select(f"mean_{c}").scalar()) for c in columns})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def drop_incomplete_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listwise deletion after the tolerant cast."""
    return df.withColumns({c: number(df, c) for c in columns}).na.drop(subset=columns)


def filter_label_rows(df: DataFrame, label: str, key: str, per_label: int = 2, values=(1, 0)) -> DataFrame:
    """The first rows (by key) of each label value; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(label).orderBy(key)
    return (
        df.where(F.col(label).isin(*values))
        .withColumn("example", F.row_number().over(w))
        .where(F.col("example") <= per_label)
    )


def numeric_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    wanted = set(names or df.columns)
    return [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, T.NumericType)]
