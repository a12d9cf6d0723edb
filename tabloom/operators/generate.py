"""Column generation as projections over row ids.

Every value is a function of (seed, field name, ``_id``): no shuffle, no state, the same rows for any
partitioning, and a preview equals the first rows of the full run.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.functions import constants as K
from tabloom.functions.rng import (
    bijection,
    choose,
    normal,
    octets,
    subseed,
    uniform,
    weighted_choice,
)
from tabloom.operators.order import key_index
from tabloom.spec import FieldSpec, TableSpec

ID = "_id"


# ---- single columns ---------------------------------------------------------------------------


def clamp(x: Column, low=None, high=None) -> Column:
    """Bound a value; a missing bound is skipped and a null value stays null."""
    out = x
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def int_uniform(idc: Column, seed, label: str, low: int, high: int, method="md5") -> Column:
    u = uniform(seed, label, idc, method=method)
    return (F.lit(int(low)) + F.floor(u * F.lit(float(int(high) - int(low) + 1)))).cast("long")


def int_unique(idc: Column, seed, label: str, low: int, high: int, n: int) -> Column:
    domain = int(high) - int(low) + 1
    if domain < n:
        raise ValueError(f"{label}: {n} distinct integers do not fit into [{low}, {high}]")
    return (F.lit(int(low)) + bijection(idc, domain, seed, label)).cast("long")


def int_normal(idc: Column, seed, label: str, mean=0.0, std=1.0, method="md5") -> Column:
    return F.rint(F.lit(float(mean)) + F.lit(float(std)) * normal(seed, label, idc, method=method)).cast("long")


def float_uniform(idc: Column, seed, label: str, low=0.0, high=100.0, method="md5") -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * uniform(seed, label, idc, method=method)


def float_normal(idc: Column, seed, label: str, mean=0.0, std=1.0, method="md5") -> Column:
    return F.lit(float(mean)) + F.lit(float(std)) * normal(seed, label, idc, method=method)


def category(idc: Column, seed, label: str, categories, probs=None, method="md5") -> Column:
    if not categories:
        return F.lit(None).cast("string")
    return weighted_choice(list(categories), probs, uniform(seed, label, idc, method=method))


def bernoulli(idc: Column, seed, label: str, p=0.5, method="md5") -> Column:
    return (uniform(seed, label, idc, method=method) < F.lit(float(p))).cast("int")


def label_exact(idc: Column, seed, n: int, p: float, label: str = "label") -> Column:
    """Exactly round(p * n) ones over ids 0..n-1, spread by a bijection instead of a shuffle."""
    ones = int(round(float(p) * n))
    if n == 0:
        return F.lit(0)
    return (bijection(idc, n, seed, label) < F.lit(ones)).cast("int")


def as_micros(value) -> int:
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    delta = moment - datetime(1970, 1, 1)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def datetime_uniform(idc: Column, seed, label: str, low=None, high=None, method="md5") -> Column:
    if not low or not high:
        low, high = K.DATE_LOW, K.DATE_HIGH
    lo, hi = sorted((as_micros(low), as_micros(high)))
    offset = F.floor(uniform(seed, label, idc, method=method) * F.lit(float(hi - lo))).cast("long")
    return F.timestamp_add(
        "MICROSECOND", F.lit(lo) + offset, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def uuid_text(idc: Column, namespace: int, name: str) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(str(namespace)), idc.cast("string"), F.lit(name)), 256)
    return F.concat_ws(
        "-", *[F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def word(idc: Column, seed, label: str, method="md5") -> Column:
    return choose(K.WORDS, uniform(seed, label, idc, method=method))


def person_name(idc: Column, seed, label: str, method="md5") -> Column:
    return F.concat_ws(
        " ",
        choose(K.FIRST_NAMES, uniform(seed, f"{label}/first", idc, method=method)),
        choose(K.LAST_NAMES, uniform(seed, f"{label}/last", idc, method=method)),
    )


def email(idc: Column, seed, label: str, method="md5") -> Column:
    return F.concat(
        F.lower(choose(K.FIRST_NAMES, uniform(seed, f"{label}/first", idc, method=method))),
        F.lit("."),
        F.lower(choose(K.LAST_NAMES, uniform(seed, f"{label}/last", idc, method=method))),
        F.lit("@"),
        choose(K.MAIL_DOMAINS, uniform(seed, f"{label}/domain", idc, method=method)),
    )


def ipv4(idc: Column, seed, label: str) -> Column:
    return F.concat_ws(".", *octets(seed, label, idc))


def sprinkle_nulls(value: Column, idc: Column, seed, label: str, share: float, method="md5") -> Column:
    return F.when(uniform(seed, f"{label}/null", idc, method=method) < F.lit(float(share)), F.lit(None)).otherwise(value)


def conditional_normal(
    parent: Column,
    idc: Column,
    seed,
    label: str,
    bands: dict,
    default: tuple[float, float],
    low=None,
    high=None,
    method="md5",
) -> Column:
    """N(mean, std) looked up by a parent value in a driver-side table of the specification.

    Mapped rows are clamped, unmapped rows take ``default`` without clamping.
    """
    pairs = [x for k, (m, s) in bands.items() for x in (F.lit(str(k)), F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")))]
    hit = F.try_element_at(F.create_map(*pairs), parent.cast("string"))
    z = normal(seed, label, idc, method=method)
    mapped = clamp(hit["m"] + hit["s"] * z, low, high)
    return F.when(hit.isNotNull(), mapped).otherwise(F.lit(float(default[0])) + F.lit(float(default[1])) * z)


# ---- repairs ----------------------------------------------------------------------------------


def _repeated(df: DataFrame, column: str, key: str) -> DataFrame:
    """(_v, _first): the values held more than once with their first key.

    Counting is combined before the shuffle and only repeated values stay, so this side is small when
    repeats are rare and adaptive execution then leaves the rows where they are.
    """
    held = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v"))
    return held.agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def repair_unique(df: DataFrame, column: str, key: str = ID) -> DataFrame:
    """Later duplicates (by ``key``, a unique integer) get a suffix of underscores and key; the first holder keeps its value.

    The underscores are one more than any value has before a number at its end, one if none has, so a repaired
    value can neither be an original one nor another repaired one. No window over a value: a hot value never
    meets in one task.
    """
    out = df.withColumn(column, F.col(column).cast("string"))
    most = out.agg(F.coalesce(F.max(F.length(F.regexp_extract(column, "(_+)-?[0-9]+$", 1))), F.lit(0)).alias("m"))
    suffix = F.concat(F.repeat(F.lit("_"), most.select("m").scalar() + 1), F.col(key).cast("string"))
    again = F.col("_first").isNotNull() & (F.col(key) != F.col("_first"))
    repeated = _repeated(out, column, key)
    return (
        out.join(repeated, out[column] == repeated["_v"], "left")
        .withColumn(column, F.when(again, F.concat(column, suffix)).otherwise(F.col(column)))
        .drop("_v", "_first")
    )


def repair_unique_int(df: DataFrame, column: str, key: str = ID) -> DataFrame:
    """Later duplicates move above the maximum, one by one, so the column stays an integer."""
    repeated = _repeated(df, column, key)
    flagged = df.join(repeated, df[column] == repeated["_v"], "left").withColumn(
        "_dup", F.coalesce(F.col(key) != F.col("_first"), F.lit(False))
    ).drop("_v", "_first")
    top = df.agg(F.max(column).alias("t"))
    moved = key_index(flagged.where("_dup"), key, "_i").withColumn(
        column, (top.select("t").scalar() + 1 + F.col("_i")).cast("long")
    ).drop("_i", "_dup")
    return flagged.where("not _dup").drop("_dup").unionByName(moved)


def avoid_key_collision(new: DataFrame, existing: DataFrame, column: str, rehash, max_rounds: int = 8) -> DataFrame:
    """Replace keys of ``new`` that ``existing`` already has; ``rehash(round)`` gives the next column."""
    taken = existing.select(F.col(column).alias("_taken")).distinct()
    out = new
    for step in range(1, max_rounds + 1):
        if out.join(taken, out[column] == taken["_taken"], "left_semi").isEmpty():
            return out
        marked = out.join(taken, out[column] == taken["_taken"], "left")
        out = marked.withColumn(
            column, F.when(F.col("_taken").isNotNull(), rehash(step)).otherwise(F.col(column))
        ).drop("_taken")
    raise ValueError(f"{column}: keys still collide after {max_rounds} rounds")


# ---- whole tables -----------------------------------------------------------------------------


def bands_from(mapping: dict, fallback: tuple[float, float]) -> dict:
    return {
        k: (float(v.get("mean", fallback[0])), float(v.get("std", fallback[1]))) if isinstance(v, dict) else v
        for k, v in mapping.items()
    }


def amount_driver(spec: TableSpec, f: FieldSpec, earlier: list[str]) -> tuple[str, dict] | None:
    """The first category column that drives a float field, with its bands."""
    fallback = (150.0 if f.mean is None else f.mean, 50.0 if f.std is None else f.std)
    mined = (spec.metadata.get("llm_priors") or {}).get("dependencies", [])
    for parent in earlier:
        declared = (f.metadata.get("conditional_on") or {}).get(parent)
        if declared:
            return parent, bands_from(declared, fallback)
        for dep in mined:
            rule = dep.get("condition") or dep.get("rule")
            if (dep.get("parent") or dep.get("from")) == parent and (dep.get("child") or dep.get("to")) == f.name:
                if isinstance(rule, dict):
                    return parent, bands_from(rule, fallback)
        if K.linked_by_name(parent, f.name):
            return parent, dict(K.CATEGORY_AMOUNT)
    return None


def role_bands(spec: TableSpec, learned: dict | None = None) -> dict:
    bands = {**K.ROLE_SALARY, **(learned or {})}
    for role, v in (spec.metadata.get("conditional_overrides") or {}).items():
        bands[str(role)] = (float(v["mean"]), float(v.get("std", 1.0)) or 1.0)
    return bands


def numeric_prior(spec: TableSpec, f: FieldSpec) -> FieldSpec:
    """The field with the moments and bounds that it lacks itself taken from a numeric prior of the specification."""
    prior = (spec.metadata.get("llm_priors") or {}).get("priors", {}).get(f.name, {})
    told = prior.get("distribution") if prior.get("type") == "numeric" else None
    if not f.numeric or not isinstance(told, dict):
        return f
    told = {**(told.get("params") or {}), **told}
    fresh = {p: told[p] for p in ("mean", "std", "min", "max") if getattr(f, p) is None and isinstance(told.get(p), (int, float))}
    return replace(f, **fresh)


def with_numeric_priors(spec: TableSpec) -> TableSpec:
    return replace(spec, fields=tuple(numeric_prior(spec, f) for f in spec.fields))


def independent_column(f: FieldSpec, spec: TableSpec, seed, idc: Column, n: int | None, method: str) -> Column:
    """The column of a field that needs no other column."""
    mean, std = (0.0 if f.mean is None else f.mean), (1.0 if f.std is None else f.std)
    if f.type == "category":
        prior = (spec.metadata.get("llm_priors") or {}).get("priors", {}).get(f.name, {})
        if prior.get("type") == "categorical":
            return category(idc, seed, f.name, [str(c) for c in prior.get("categories", f.categories)],
                            prior.get("probs", f.probs), method)
        return category(idc, seed, f.name, f.categories, f.probs, method)
    if f.type == "int":
        if f.distribution == "normal":
            return int_normal(idc, seed, f.name, mean, std, method)
        low, high = (0 if f.min is None else f.min), (100 if f.max is None else f.max)
        if f.unique:
            if n is None:
                raise ValueError(f"{f.name}: unique integers need the row count")
            return int_unique(idc, seed, f.name, low, high, n)
        return int_uniform(idc, seed, f.name, low, high, method)
    if f.type == "float":
        if f.distribution == "normal":
            return float_normal(idc, seed, f.name, mean, std, method)
        return float_uniform(idc, seed, f.name, 0.0 if f.min is None else f.min,
                             100.0 if f.max is None else f.max, method)
    if f.type == "bool":
        return bernoulli(idc, seed, f.name, 0.5 if f.p is None else f.p, method)
    if f.type == "datetime":
        return datetime_uniform(idc, seed, f.name, f.min, f.max, method)
    if f.type == "ip":
        return ipv4(idc, seed, f.name)
    examples = (spec.metadata.get("crawl_examples") or {}).get(f.name)
    if examples:
        return choose([str(e) for e in examples], uniform(seed, f"examples/{f.name}", idc, method=method))
    if f.format == "uuid":
        return uuid_text(idc, subseed(seed, f"uuid::{f.name}"), f.name)
    maker = {"email": email, "name": person_name}.get(f.format, word)
    return maker(idc, seed, f.name, method)


def generate(
    spark: SparkSession,
    spec: TableSpec,
    seed: int | str = 42,
    n: int | None = None,
    ids: DataFrame | None = None,
    method: str = "md5",
    with_nulls: bool = False,
    repair: bool = True,
    learned_roles: dict | None = None,
    first_id: int = 0,
) -> DataFrame:
    """The table of a specification with its ``_id`` column.

    ``ids`` may supply the ids (then ``n`` is their domain size); otherwise they are
    ``first_id .. first_id + n - 1``.
    """
    spec = with_numeric_priors(spec)
    n = spec.n_rows if n is None and ids is None else n
    rows = ids.select(ID) if ids is not None else spark.range(first_id, first_id + max(0, n)).toDF(ID)
    idc = F.col(ID)
    domain = None if n is None else n + first_id
    roles = [f.name for f in spec.fields if f.name == "role" or f.metadata.get("conditional_driver")]
    role = roles[0] if roles else None

    plain, dependent, seen = [], [], [role] if role else []
    for f in spec.fields:
        if f.name == "label" and "1" in spec.class_balance:
            if domain is None:
                raise ValueError("an exact label balance needs the row count")
            col = label_exact(idc - F.lit(first_id), seed, n, spec.class_balance["1"], f.name)
            plain.append(col.alias(f.name))
            continue
        if f.name == role:
            cats = list(f.categories) or [K.DEFAULT_ROLE]
            plain.append(category(idc, seed, f.name, cats, f.probs, method).alias(f.name))
            continue
        if f.type == "int" and role and "salary" in f.name:
            bands = role_bands(spec, learned_roles)
            x = conditional_normal(F.col(role), idc, seed, f.name, bands, bands[K.DEFAULT_ROLE], method=method)
            dependent.append(F.rint(x).cast("long").alias(f.name))
            continue
        driver = amount_driver(spec, f, seen) if f.type == "float" else None
        if driver:
            default = (0.0 if f.mean is None else f.mean, 1.0 if f.std is None else f.std)
            x = conditional_normal(F.col(driver[0]), idc, seed, f.name, driver[1], default, f.min, f.max, method)
            dependent.append(x.alias(f.name))
            continue
        plain.append(independent_column(f, spec, seed, idc, domain, method).alias(f.name))
        if f.type == "category":
            seen.append(f.name)
    df = rows.select(ID, *plain)
    if dependent:
        df = df.select("*", *dependent)
    if repair:
        for f in spec.fields:
            if not f.unique or f.type in ("bool", "datetime") or f.format == "uuid":
                continue
            if f.type == "int":
                if f.distribution != "uniform":
                    df = repair_unique_int(df, f.name)
            else:
                df = repair_unique(df, f.name)
    if with_nulls:
        for f in spec.fields:
            if f.nullable > 0:
                df = df.withColumn(f.name, sprinkle_nulls(F.col(f.name), idc, seed, f.name, f.nullable, method))
    return df.select(ID, *spec.names())


def preview(spark: SparkSession, spec: TableSpec, seed: int | str = 42, rows: int = 10, **options) -> DataFrame:
    """First rows of the full run."""
    if "1" in spec.class_balance or any(f.unique and f.type == "int" for f in spec.fields):
        full = generate(spark, spec, seed, spec.n_rows, **options)
        return full.where(F.col(ID) < rows)
    return generate(spark, spec, seed, rows, **options)
