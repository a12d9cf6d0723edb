"""Redaction and mining of text columns, on the JVM side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions import patterns as P
from tabloom.operators.profile import stack_rows


def _pattern(regex: str, unicode: bool) -> str:
    return f"(?U){regex}" if unicode else regex


def redact_page(c: Column, unicode: bool = True) -> Column:
    """E-mail, phone and SSN marks, in this order; ``unicode`` widens word and digit classes."""
    for _, regex, mark in P.PAGE_PII:
        c = F.regexp_replace(c, _pattern(regex, unicode), mark)
    return c


def redact_pii_page(df: DataFrame, text: str, unicode: bool = True) -> DataFrame:
    return df.withColumn(text, redact_page(F.col(text), unicode))


def redact_pii_counts(df: DataFrame, text: str, unicode: bool = True) -> DataFrame:
    """Redact five kinds in order and add ``n_<kind>``; each step reads the text left by the one before."""
    out = df
    for kind, regex, mark in P.COUNTED_PII:
        rx = _pattern(regex, unicode)
        out = out.withColumn(f"n_{kind}", F.coalesce(F.regexp_count(F.col(text), F.lit(rx)), F.lit(0))).withColumn(
            text, F.regexp_replace(F.col(text), rx, mark))
    return out


def pii_summary(df: DataFrame, text: str, by: list[str], unicode: bool = True) -> DataFrame:
    """(by..., kind, rows_hit, hits)."""
    counted = redact_pii_counts(df.select(*by, text), text, unicode)
    kinds = [k for k, _, _ in P.COUNTED_PII]
    g = counted.groupBy(*by).agg(
        *[F.sum(f"n_{k}").alias(f"hits_{k}") for k in kinds], *[F.count_if(F.col(f"n_{k}") > 0).alias(f"rows_{k}") for k in kinds])
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"rows_{k}").alias("rows_hit"), F.col(f"hits_{k}").alias("hits")) for k in kinds])
    return g.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def mine_numbers(df: DataFrame, text: str, hint: str = "", min_samples: int = 5, order: list[str] = (), first: int | None = None) -> DataFrame:
    """One row (samples, mean, std, min, max) over all numbers of the texts; null below ``min_samples``.

    A hint with "salary" keeps 1e3..1e7. ``first`` limits to the first numbers in (order, position).
    """
    hits = F.regexp_extract_all(F.col(text), F.lit(P.NUMBER), F.lit(1))
    x = df.select(*order, F.posexplode(hits).alias("pos", "hit")).withColumn("x", F.replace(F.col("hit"), F.lit(","), F.lit("")).try_cast("double"))
    x = x.where(F.col("x").isNotNull())
    if "salary" in hint.lower():
        x = x.where((F.col("x") >= 1000) & (F.col("x") <= 1e7))
    if first:
        x = x.orderBy(*order, "pos").limit(first)
    g = x.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    enough = F.col("n") >= min_samples
    return g.select(
        F.col("n").alias("samples"), F.when(enough, F.col("m")).alias("mean"), F.when(enough, F.coalesce("s", F.lit(0.0))).alias("std"),
        F.when(enough, F.col("lo")).alias("min"), F.when(enough, F.col("hi")).alias("max"))


def mine_category_shares(df: DataFrame, text: str, hint: str, categories: list[str]) -> DataFrame:
    """(value, samples, prob): words of the texts that contain the hint, counted per contained category.

    Words are counted first; every category is one conditional sum over the distinct words.
    """
    words = df.where(F.contains(F.lower(F.col(text)), F.lit(hint.lower()))).select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(P.TOKEN), F.lit(0))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(*[
        F.coalesce(F.sum(F.when(F.contains(F.col("w"), F.lit(c.lower())), F.col("n"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(categories)])
    total = sum((F.col(f"c{i}") for i in range(len(categories))), F.lit(0))
    one = one.withColumn("total", total).where("total > 0")
    return stack_rows(one, [
        {"value": F.lit(c), "samples": F.col(f"c{i}"), "prob": F.col(f"c{i}") / F.col("total")} for i, c in enumerate(categories)])


def mine_examples(df: DataFrame, text: str, key: str, hint: str, max_examples: int = 50, max_words: int = 12, unicode: bool = True) -> DataFrame:
    """(position, example): the first distinct redacted lines that contain the hint or are short."""
    breaks = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), breaks)).alias("pos", "line")).withColumn(
        "line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    words = F.size(F.split("line", r"\s+"))
    kept = lines.where(F.contains(F.lower("line"), F.lit(hint.lower())) | (words <= max_words))
    seen = kept.select(redact_page(F.col("line"), unicode).alias("example"), F.struct(key, "pos").alias("at"))
    firsts = seen.groupBy("example").agg(F.min("at").alias("at")).orderBy("at").limit(max_examples)
    return firsts.select(F.col(f"at.{key}").alias(key), F.col("at.pos").alias("pos"), "example")


def merge_mined_priors(spec_rows: DataFrame, mined: DataFrame, min_samples: int = 5) -> DataFrame:
    """Take over mined moments with enough samples; bounds get tighter, never wider.

    ``spec_rows``: field, mean, std, min, max; ``mined``: field, samples, mean, std, min, max.
    """
    m = mined.where(F.col("samples") >= min_samples).select("field", *[F.col(c).alias(f"_{c}") for c in ("mean", "std", "min", "max")])
    return spec_rows.join(m, "field", "left").select(
        "field", F.coalesce("_mean", "mean").alias("mean"),
        F.when(F.col("_std").isNotNull(), F.greatest(F.lit(1e-9), F.col("_std"))).otherwise(F.col("std")).alias("std"),
        F.greatest("min", "_min").alias("min"), F.least("max", "_max").alias("max"))


def merge_mined_shares(spec_rows: DataFrame, mined: DataFrame, min_samples: int = 5) -> DataFrame:
    """(field, value, prob): mined shares replace a field's own ones when they rest on enough samples."""
    total = mined.groupBy("field").agg(F.sum("samples").alias("_n")).where(F.col("_n") >= min_samples)
    fresh = mined.join(total, "field", "left_semi").select("field", "value", "prob")
    return spec_rows.join(total, "field", "left_anti").select("field", "value", "prob").unionByName(fresh)


# ---- pages ------------------------------------------------------------------------------------

# The character references that are decoded, ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode(c: Column) -> Column:
    for mark, char in ENTITIES:
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def page_text(html: Column) -> Column:
    """Text of every p, li and span element in document order, one line per element.

    The look-ahead lets an element inside another one give its own line too; an element nested in one of
    the same name ends at the first closing tag.
    """
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    elements = F.regexp_extract_all(clean, F.lit(r"(?is)<(?=(p|li|span)\b[^>]*>(.*?)</\1>)"), F.lit(2))

    def line(e):
        pieces = F.transform(F.split(e, r"<[^>]*>"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
        return F.array_join(F.filter(pieces, lambda s: s != ""), " ")

    return decode(F.array_join(F.transform(elements, line), "\n"))


def page_text_source(pages: DataFrame, allow_profiles: bool = False, max_chars: int | None = None) -> DataFrame:
    """(page_id, url, title, text) with redacted text; profile addresses are left out."""
    df = pages
    if not allow_profiles:
        for part in P.PROFILE_URLS:
            df = df.where(~F.contains(F.col("url"), F.lit(part)))
    text = page_text(F.col("html"))
    text = F.substring(text, 1, max_chars) if max_chars else text
    title = decode(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return df.select("page_id", "url", title.alias("title"), redact_page(text).alias("text"))
