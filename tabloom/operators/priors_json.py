"""Priors given as JSON text: parse, check, normalise and turn into the learned tables' shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions import patterns as P
from tabloom.operators.text import redact_pii_counts

TEXT_MAP = "map<string,string>"
EMPTY = '{"schema_hint":{"columns":[],"notes":"unreadable answer"},"priors":{},"dependencies":[],"examples":[]}'


def json_object(c: Column) -> Column:
    """The fenced JSON object of a text, else everything between the first and the last brace."""
    fenced = F.regexp_extract(c, P.FENCED_JSON, 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, P.BARE_JSON, 1))


def parse_priors_json(df: DataFrame, text: str, unicode: bool = True) -> DataFrame:
    """Add ``priors_json`` (a valid object or the empty one), ``is_valid``, ``problems`` and ``n_redactions``."""
    red = redact_pii_counts(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), "_t", unicode)
    kinds = [f"n_{k}" for k, _, _ in P.COUNTED_PII]
    top = F.from_json(F.col("_j"), TEXT_MAP)
    out = red.withColumn("_j", json_object(F.col("_t"))).withColumn("_top", top)
    readable = F.col("_top").isNotNull() & (F.size(F.map_keys("_top")) > 0)
    out = out.withColumn("_priors", F.from_json(F.try_element_at("_top", F.lit("priors")), TEXT_MAP))
    missing = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.map_contains_key("_top", k), F.lit(False)), F.lit(f"missing key {k}")) for k in P.PRIORS_KEYS]))

    def entry_problem(e):
        body = F.from_json(e["value"], TEXT_MAP)
        kind = F.try_element_at(body, F.lit("type"))
        has = lambda k: F.coalesce(F.map_contains_key(body, k), F.lit(False))
        said = lambda what: F.concat(e["key"], F.lit(f": {what}"))
        return (
            F.when(~has("type"), said("no type"))
            .when((kind == "categorical") & ~(has("categories") & has("probs")), said("no categories or probs"))
            .when((kind == "numeric") & ~has("distribution"), said("no distribution"))
        )

    inner = F.array_compact(F.transform(F.coalesce(F.map_entries("_priors"), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>")), entry_problem))
    problems = F.when(~readable, F.array(F.lit("no JSON object"))).otherwise(F.concat(missing, F.sort_array(inner)))
    out = out.withColumn("problems", problems).withColumn("is_valid", (F.size("problems") == 0).cast("int"))
    # Missing entries in single priors are tolerated; missing top keys give the empty object.
    usable = readable & (F.size(missing) == 0)
    return (
        out.withColumn("n_redactions", sum((F.col(k) for k in kinds), F.lit(0)))
        .withColumn("priors_json", F.when(usable, F.col("_j")).otherwise(F.lit(EMPTY)))
        .drop("_t", "_j", "_top", "_priors", *kinds)
    )


def normalize_probs(categories: Column, probs: Column) -> Column:
    """Probabilities that sum to 1; a wrong length or a zero sum becomes uniform."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    even = F.transform(categories, lambda _: F.lit(1.0) / F.size(categories))
    good = F.coalesce((F.size(probs) == F.size(categories)) & (total > 0), F.lit(False))
    return F.when(good, F.transform(probs, lambda x: F.coalesce(x, F.lit(0.0)) / total)).otherwise(even)


def normalize_prior_probs(df: DataFrame, categories: str = "categories", probs: str = "probs") -> DataFrame:
    return df.withColumn(probs, normalize_probs(F.col(categories), F.col(probs)))


def _entries(c: Column) -> Column:
    return F.explode(F.map_entries(F.from_json(c, TEXT_MAP)))


def _number(body: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a number."""
    return F.coalesce(*[F.get_json_object(body, p).try_cast("double") for p in paths])


def priors_to_tables(df: DataFrame, key: str, priors_json: str = "priors_json") -> dict[str, DataFrame]:
    """category, numeric, conditional_numeric, conditional_category and edges tables, each with ``key``.

    Both spellings are read: moments in ``distribution`` or in ``distribution.params``, conditions in
    ``dependencies[].condition`` or in ``conditionals[].when``.
    """
    doc = F.col(priors_json)
    cols = df.select(key, _entries(F.get_json_object(doc, "$.priors")).alias("e")).select(
        key, F.col("e.key").alias("field"), F.col("e.value").alias("body"))
    kind = F.get_json_object("body", "$.type")

    cats = cols.where(kind == "categorical").select(
        key, "field", F.from_json(F.get_json_object("body", "$.categories"), "array<string>").alias("categories"),
        F.coalesce(F.from_json(F.get_json_object("body", "$.probs"), "array<double>"), F.from_json(F.lit("[]"), "array<double>")).alias("probs"))
    category = normalize_prior_probs(cats).select(
        key, "field", F.explode(F.arrays_zip("categories", "probs")).alias("z")).select(
        key, "field", F.col("z.categories").alias("value"), F.col("z.probs").alias("prob"))

    numeric = cols.where(kind == "numeric").select(key, "field", *[
        _number(F.col("body"), f"$.distribution.{p}", f"$.distribution.params.{p}", f"$.{p}").alias(p) for p in ("mean", "std", "min", "max")])
    numeric = numeric.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("std", F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)))

    deps = df.select(key, F.explode(F.from_json(F.get_json_object(doc, "$.dependencies"), "array<string>")).alias("d")).select(
        key,
        F.coalesce(F.get_json_object("d", "$.parent"), F.get_json_object("d", "$.from")).alias("parent"),
        F.coalesce(F.get_json_object("d", "$.child"), F.get_json_object("d", "$.to")).alias("child"),
        F.coalesce(F.get_json_object("d", "$.condition"), F.get_json_object("d", "$.rule")).alias("rule"),
    ).where("parent is not null and child is not null")
    rules = deps.select(key, "parent", "child", _entries(F.col("rule")).alias("e")).select(
        key, "parent", "child", F.col("e.key").alias("parent_value"), F.col("e.value").alias("body"))
    direct = rules.where(_number(F.col("body"), "$.mean", "$.std").isNotNull()).select(
        key, "parent", "parent_value", "child", _number(F.col("body"), "$.mean").alias("mean"), _number(F.col("body"), "$.std").alias("std"))
    listed = cols.select(key, F.col("field").alias("child"), F.explode(
        F.from_json(F.get_json_object("body", "$.conditionals"), "array<string>")).alias("c"))
    listed = listed.select(key, "child", F.col("c"), _entries(F.get_json_object("c", "$.when")).alias("w")).select(
        key, F.col("w.key").alias("parent"), F.col("w.value").alias("parent_value"), "child",
        _number(F.col("c"), "$.distribution.mean", "$.distribution.params.mean").alias("mean"),
        _number(F.col("c"), "$.distribution.std", "$.distribution.params.std").alias("std"))
    cond_num = direct.unionByName(listed).join(
        numeric.select(key, F.col("field").alias("child"), F.col("mean").alias("_m"), F.col("std").alias("_s")), [key, "child"], "left"
    ).select(key, "parent", "parent_value", "child", F.coalesce("mean", "_m", F.lit(0.0)).alias("mean"),
             F.coalesce(F.nullif("std", F.lit(0.0)), F.col("_s"), F.lit(1.0)).alias("std"))

    # {child value: probability}; a value that is an object belongs to the numeric rules above.
    shares = rules.where(_number(F.col("body"), "$.mean", "$.std").isNull()).select(
        key, "parent", "parent_value", "child", F.from_json("body", "map<string,double>").alias("p"))
    shares = shares.where("p is not null").select(
        key, "parent", "parent_value", "child", F.map_keys("p").alias("categories"), F.map_values("p").alias("probs"))
    cond_cat = normalize_prior_probs(shares).select(
        key, "parent", "parent_value", "child", F.explode(F.arrays_zip("categories", "probs")).alias("z")).select(
        key, "parent", "parent_value", "child", F.col("z.categories").alias("child_value"), F.col("z.probs").alias("prob"))
    return {
        "category": category, "numeric": numeric, "conditional_numeric": cond_num,
        "conditional_category": cond_cat, "edges": deps.select(key, "parent", "child"),
    }
