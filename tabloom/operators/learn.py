"""Learn priors from a reference table; every prior is a tidy table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.constants import linked_by_name
from tabloom.operators import profile
from tabloom.operators.coerce import drop_incomplete_numeric
from tabloom.operators.order import run_lengths
from tabloom.sources.runtime import materialize
from tabloom.spec import TableSpec


@dataclass
class Priors:
    """Learned tables.

    category (field, value, n, prob); numeric (field, mean, std, min, max);
    conditional_numeric (parent, parent_value, child, n, mean, std);
    conditional_category (parent, parent_value, child, child_value, samples, prob);
    spearman and covariance (a, b, value); quantiles (field, value, n, n_before, n_total);
    warnings (subject, message).
    """

    category: DataFrame
    numeric: DataFrame
    conditional_numeric: DataFrame
    conditional_category: DataFrame
    spearman: DataFrame
    covariance: DataFrame
    quantiles: DataFrame
    warnings: DataFrame

    def write(self, path: str) -> None:
        """Write all tables; the jobs are independent, so they run side by side."""
        def one(name: str) -> None:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(one, [f.name for f in fields(self)]))

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Priors":
        return Priors(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Priors)})


def dependency_edges(spec: TableSpec) -> list[tuple[str, str]]:
    return [(d["parent"], d["child"]) for d in spec.metadata.get("dependency_graph", []) if d.get("parent") and d.get("child")]


def numeric_parents(spec: TableSpec, child: str) -> list[str]:
    """Declared category parents of a numeric field, else those that the name rule links."""
    declared = [p for p, c in dependency_edges(spec) if c == child]
    if declared:
        return [p for p in declared if p in spec.names("category")]
    return [p for p in spec.names("category") if linked_by_name(p, child)]


def category_parents(spec: TableSpec, child: str) -> list[str]:
    return [p for p, c in dependency_edges(spec) if c == child and p != child and p in spec.names("category")]


def union_all(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def category_priors(df: DataFrame, spec: TableSpec, alpha: float = 1.0) -> DataFrame:
    """Smoothed shares of all category fields in one scan, over declared or observed categories."""
    cats = [c for c in spec.names("category") if c in df.columns]
    if not cats:
        return df.sparkSession.createDataFrame([], "field string, value string, n long, prob double")
    counts = profile.value_counts(df, cats)
    declared = [(c, v) for c in cats for v in spec[c].categories]
    if declared:
        wanted = df.sparkSession.createDataFrame(declared, "field string, value string")
        closed = sorted({c for c, _ in declared})
        listed = wanted.join(counts, ["field", "value"], "left")
        counts = listed.unionByName(counts.where(~F.col("field").isin(*closed)))
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    totals = counts.groupBy("field").agg(F.sum(F.col("n") + F.lit(float(alpha))).alias("t"))
    return counts.join(F.broadcast(totals), "field").select(
        "field", "value", "n", F.try_divide(F.col("n") + F.lit(float(alpha)), F.col("t")).alias("prob"))


def learn_priors(df: DataFrame, spec: TableSpec, min_samples: int = 20, alpha: float = 1.0) -> Priors:
    spark = df.sparkSession
    wanted = [c for c in spec.names() if c in df.columns]
    base = df.select(*wanted)
    numeric = [c for c in spec.names("int", "float") if c in wanted]
    pairs = [(p, c) for c in numeric for p in numeric_parents(spec, c) if p in wanted]
    links = [(p, c) for c in spec.names("category") if c in wanted for p in category_parents(spec, c) if p in wanted]

    cond = (
        profile.conditional_numeric(base, pairs, min_samples)
        if pairs
        else spark.createDataFrame([], "parent string, parent_value string, child string, n long, mean double, std double, enough int")
    )
    too_few = cond.where("enough = 0").select(
        F.col("child").alias("subject"),
        F.concat(F.lit("insufficient samples for "), "child", F.lit("|"), "parent", F.lit("="), "parent_value").alias("message"))
    absent = [(n, "not in the reference table") for n in spec.names() if n not in df.columns]
    warnings = too_few.unionByName(spark.createDataFrame(absent, "subject string, message string"))
    tables = [profile.conditional_category_table(base, p, c, alpha) for p, c in links]
    cpt = "parent string, parent_value string, child string, child_value string, samples long, prob double"
    # One small row per pair of columns; both matrices come from the same ranking.
    if len(numeric) > 1:
        matrices = materialize(profile.rank_matrices(drop_incomplete_numeric(base, numeric), numeric), "matrices")
    else:
        matrices = spark.createDataFrame([], "a string, b string, spearman double, covariance double")
    return Priors(
        category=category_priors(base, spec, alpha),
        numeric=profile.global_numeric(base, numeric) if numeric else spark.createDataFrame(
            [], "field string, mean double, std double, min double, max double"),
        conditional_numeric=cond.where("enough = 1").drop("enough"),
        conditional_category=union_all(tables, spark, cpt),
        spearman=matrices.select("a", "b", F.col("spearman").alias("value")),
        covariance=matrices.select("a", "b", F.col("covariance").alias("value")),
        quantiles=run_lengths(base, numeric) if numeric else spark.createDataFrame(
            [], "field string, value double, n long, n_before long, n_total long"),
        warnings=warnings,
    )
