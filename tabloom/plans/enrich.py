"""A specification enriched by what texts say: shares of categories, moments and bounds of numbers, examples of strings.

Every field has a hint (its name, if none is given); the texts that contain the hint speak for the field. All fields of a kind are
mined together in one scan, so the work does not grow with their number but through the texts that several hints share.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions import patterns as P
from tabloom.operators.text import merge_mined_priors, merge_mined_shares, redact_page
from tabloom.spec import TableSpec

MOMENTS = ("mean", "std", "min", "max")


def texts_by_field(texts: DataFrame, text: str, key: str, hints: dict[str, str]) -> DataFrame:
    """(key, text, field): a row for every field whose hint the text contains."""
    heard = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.col(text)), F.lit(h.lower())), F.lit(f)) for f, h in hints.items()]))
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(heard).alias("field"))


def mined_numbers(heard: DataFrame, salaries: list[str]) -> DataFrame:
    """(field, samples, mean, std, min, max) of the numbers in a field's texts; ``salaries`` are fields that keep 1e3..1e7 alone."""
    x = heard.select("field", F.explode(F.regexp_extract_all("text", F.lit(P.NUMBER), F.lit(1))).alias("hit")).select(
        "field", F.replace(F.col("hit"), F.lit(","), F.lit("")).try_cast("double").alias("x")).where("x IS NOT NULL")
    if salaries:
        x = x.where(~F.col("field").isin(*salaries) | F.col("x").between(1e3, 1e7))
    return x.groupBy("field").agg(F.count("x").alias("samples"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"),
                                  F.min("x").alias("min"), F.max("x").alias("max"))


def mined_shares(heard: DataFrame, categories: DataFrame) -> DataFrame:
    """(field, value, samples, prob): words of a field's texts counted for the categories they contain; none is 0."""
    words = heard.select("field", F.explode(F.regexp_extract_all("text", F.lit(P.TOKEN), F.lit(0))).alias("w"))
    counts = words.groupBy("field", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # The categories are those listed in the specification.
    hits = F.sum(F.when(F.contains(F.col("w"), F.lower("value")), F.col("n")))
    found = counts.join(F.broadcast(categories), "field").groupBy("field", "value").agg(F.coalesce(hits, F.lit(0)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy("field"))
    return found.withColumn("_t", total).where("_t > 0").select("field", "value", "samples", (F.col("samples") / F.col("_t")).alias("prob"))


def mined_examples(heard: DataFrame, hints: dict[str, str], most: int = 30, max_words: int = 12, unicode: bool = True) -> DataFrame:
    """(field, place, example): the first distinct redacted lines that contain the field's hint or are short."""
    lines = heard.select("field", "key", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E]")).alias("pos", "line")).withColumn(
        "line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    pairs = [x for f, h in hints.items() for x in (F.lit(f), F.lit(h.lower()))]
    hint = F.try_element_at(F.create_map(*pairs), F.col("field"))
    kept = lines.where(F.contains(F.lower("line"), hint) | (F.size(F.split("line", r"\s+")) <= max_words))
    firsts = kept.groupBy("field", redact_page(F.col("line"), unicode).alias("example")).agg(F.min(F.struct("key", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("at"))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select("field", "place", "example")


def enriched_numbers(spec: TableSpec, heard: DataFrame, hints: dict[str, str], min_samples: int = 5) -> DataFrame:
    """(field, mean, std, min, max) of the numeric fields after mining."""
    rows = [(f.name, *(None if getattr(f, p) is None else float(getattr(f, p)) for p in MOMENTS)) for f in spec.fields if f.numeric and f.name in hints]
    own = heard.sparkSession.createDataFrame(rows, "field string, mean double, std double, min double, max double")
    salaries = [f for f, h in hints.items() if "salary" in h.lower()]
    return merge_mined_priors(own, mined_numbers(heard, salaries), min_samples)


def enriched_shares(spec: TableSpec, heard: DataFrame, hints: dict[str, str], min_samples: int = 5) -> DataFrame:
    """(field, value, prob) of the category fields after mining; a category never met keeps its place with a share of 0."""
    listed = [(f.name, c, f.probs[i] if f.probs else 1.0 / len(f.categories)) for f in spec.fields if f.type == "category" and f.name in hints for i, c in enumerate(f.categories)]
    own = heard.sparkSession.createDataFrame(listed, "field string, value string, prob double")
    return merge_mined_shares(own, mined_shares(heard, own.select("field", "value")), min_samples)


def enrich(spec: TableSpec, texts: DataFrame, text: str = "text", key: str = "page_id", hints: dict[str, str] | None = None,
           min_samples: int = 5, examples: int = 30) -> tuple[TableSpec, DataFrame]:
    """(the specification with what the texts say, a report (field, kind, changed)).

    Shares and moments are taken over from ``min_samples`` hits on; bounds get tighter, never wider; examples are redacted. Fields that
    the texts say nothing about stay as they are. Only parameters and at most ``examples`` lines per field reach the driver.
    """
    wanted = {f.name: (hints or {}).get(f.name, f.name) for f in spec.fields if f.numeric or f.type == "category" and f.categories or f.type == "string"}

    def heard(*names: str) -> DataFrame:
        return texts_by_field(texts, text, key, {n: wanted[n] for n in names})

    numbers, kinds, strings = ([f.name for f in spec.fields if f.name in wanted and t(f)] for t in (
        lambda f: f.numeric, lambda f: f.type == "category", lambda f: f.type == "string"))
    changes: dict[str, dict] = {}
    report: list[tuple] = []
    if numbers:
        for r in enriched_numbers(spec, heard(*numbers), {n: wanted[n] for n in numbers}, min_samples).collect():
            old = spec[r["field"]]
            fresh = {p: r[p] for p in MOMENTS if r[p] is not None and (getattr(old, p) is None or float(getattr(old, p)) != r[p])}
            changes[r["field"]] = fresh
            report.append((r["field"], "number", bool(fresh)))
    if kinds:
        shares: dict[str, dict] = {}
        for r in enriched_shares(spec, heard(*kinds), {n: wanted[n] for n in kinds}, min_samples).collect():
            shares.setdefault(r["field"], {})[r["value"]] = r["prob"]
        for name, by_value in shares.items():
            probs = tuple(by_value.get(c, 0.0) for c in spec[name].categories)
            own = spec[name].probs or tuple(1.0 / len(probs) for _ in probs)
            if probs != own:
                changes[name] = {"probs": probs}
            report.append((name, "category", probs != own))
    told: dict[str, list] = {}
    if strings:
        for r in mined_examples(heard(*strings), {n: wanted[n] for n in strings}, examples).orderBy("field", "place").collect():
            told.setdefault(r["field"], []).append(r["example"])
        report += [(n, "string", n in told) for n in strings]
    out = spec.with_fields(**{n: c for n, c in changes.items() if c})
    if told:
        out = replace(out, metadata={**out.metadata, "crawl_examples": {**(out.metadata.get("crawl_examples") or {}), **told}})
    return out, texts.sparkSession.createDataFrame(report, "field string, kind string, changed boolean")
