"""Generation that keeps learned conditionals and rank correlation."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.functions.rng import normal, uniform
from tabloom.functions.special import norm_cdf
from tabloom.operators.coerce import drop_incomplete_numeric
from tabloom.operators.generate import ID, clamp, independent_column
from tabloom.operators.learn import Priors, category_parents, dependency_edges, numeric_parents
from tabloom.operators.order import cut_points, deal_values, order_plans, prefix_sums, run_lengths, value_at, values_in_place
from tabloom.operators.profile import spearman_matrix, weighted_covariance, with_normal_scores
from tabloom.sources.runtime import materialize
from tabloom.spec import TableSpec


def generation_order(spec: TableSpec) -> list[str]:
    """Parents before children; without edges categories, numbers, the rest. Cycles come last."""
    edges = [(p, c) for p, c in dependency_edges(spec) if p in spec.names() and c in spec.names()]
    if not edges:
        rest = [f.name for f in spec.fields if f.type != "category" and not f.numeric]
        return spec.names("category") + spec.names("int", "float") + rest
    waiting = {n: {p for p, c in edges if c == n} for n in spec.names()}
    done: list[str] = []
    while True:
        ready = [n for n in spec.names() if n not in done and waiting[n] <= set(done)]
        if not ready:
            return done + [n for n in spec.names() if n not in done]
        done += ready


# ---- lookups ----------------------------------------------------------------------------------


def lookup_conditional_numeric(
    df: DataFrame, parent: str, stats: DataFrame, fallback: tuple, out: str, seed, low=None, high=None, key: str = ID
) -> DataFrame:
    """N(mean, std) of the parent's row in ``stats`` (parent_value, mean, std), else the fallback moments.

    ``stats`` has one row per parent value; adaptive execution broadcasts it when its measured size
    allows and otherwise splits hot parents on the row side.
    """
    s = stats.select(F.col("parent_value").alias("_pv"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    mean = fallback[0] if isinstance(fallback[0], Column) else F.lit(float(fallback[0]))
    std = fallback[1] if isinstance(fallback[1], Column) else F.lit(float(fallback[1]))
    x = F.coalesce("_m", mean) + F.greatest(F.lit(1e-9), F.coalesce("_s", std)) * normal(seed, out, key)
    # The bounds ask for the value several times; as a column of its own it is made once.
    met = df.join(s, df[parent].cast("string") == s["_pv"], "left").withColumn("_x", x)
    return met.withColumn(out, clamp(F.col("_x"), low, high)).drop("_pv", "_m", "_s", "_x")


def sampling_arrays(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., cats, cum): values in sorted order with running probabilities, the last one 1."""
    w = Window.partitionBy(*by).orderBy("child_value").rowsBetween(Window.unboundedPreceding, 0)
    run = table.withColumn("_c", F.sum("prob").over(w))
    packed = run.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("child_value", "_c"))).alias("_a"))
    return packed.select(
        *by, F.col("_a.child_value").alias("cats"),
        F.concat(F.slice(F.col("_a._c"), F.lit(1), F.size("_a") - 1), F.array(F.lit(1.0))).alias("cum"))


def pick(cats: Column, cum: Column, u: Column) -> Column:
    """The value at the draw's place; the draw is bound once, not made anew for every value."""
    return F.get(F.transform(F.array(u), lambda x: F.get(cats, F.size(F.filter(cum, lambda c: c <= x)))), 0)


def share_ranges(cpt: DataFrame) -> DataFrame:
    """(parent_value, child_value, lo, hi, slots): the stretch of [0, 1) of every child, in ascending order, and the parent's number of children."""
    line = Window.partitionBy("parent_value").orderBy("child_value")
    ran = cpt.withColumn("hi", F.sum("prob").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("child_value").over(line).isNull()
    return ran.select("parent_value", "child_value", F.coalesce(F.lag("hi").over(line), F.lit(0.0)).alias("lo"), F.when(last, F.lit(1.0)).otherwise(F.col("hi")).alias("hi"),
                      F.count(F.lit(1)).over(Window.partitionBy("parent_value")).alias("slots"))


def lookup_cpt_sample(df: DataFrame, parent: str, cpt: DataFrame, out: str, seed, key: str = ID) -> DataFrame:
    """Draw a child from P(child | parent); unseen parents draw evenly from all children, else 'unknown'.

    A draw u meets the stretches of its parent by an equi-join: [0, 1) has as many slots as the parent has children, a
    stretch is listed in the slots that it touches (two on average), and the bounds decide inside a slot. Even draws are
    looked up by the place of a child in the order of all. No list of children is held per parent or as a whole. The
    stretches and places are written once: the planner then knows their true size and sends small ones to the rows, which
    would otherwise be sorted by the few keys of their parents.
    """
    ranges = materialize(share_ranges(cpt.select("parent_value", "child_value", "prob")), "ranges")
    sizes = ranges.groupBy(F.col("parent_value").alias("_pv")).agg(F.max("slots").alias("_slots"))

    def slot(x):
        return F.least(F.col("slots") - 1, F.floor(x * F.col("slots")))

    listed = ranges.where("lo < hi").select(F.col("parent_value").alias("_pv2"), F.col("child_value").alias("_drawn"), "lo", "hi", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("_in"))
    children = ranges.select(F.col("child_value").alias("_even")).distinct().withColumn("n", F.lit(1).cast("long"))
    every = materialize(prefix_sums(children, "_even", ["n"], cut_points(children, ["_even"])["_even"]).select("_even", F.col("n_before").alias("_place")), "places")
    k = ranges.agg(F.count_distinct("child_value").alias("k")).select("k").scalar()
    drawn = df.withColumn("_u", uniform(seed, out, key)).join(sizes, df[parent].cast("string") == F.col("_pv"), "left")
    drawn = drawn.withColumn("_slot", F.least(F.col("_slots") - 1, F.floor(F.col("_u") * F.col("_slots"))))
    # Rows with a known parent ask for a place that does not exist, each for another, so they do not meet in one task.
    none = -1 - F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    drawn = drawn.withColumn("_ask", F.when(F.col("_pv").isNull(), F.floor(F.col("_u") * k)).otherwise(none))
    inside = (F.col("_pv") == F.col("_pv2")) & (F.col("_slot") == F.col("_in")) & (F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi"))
    met = drawn.join(listed, inside, "left").join(every, F.col("_ask") == F.col("_place"), "left")
    return met.withColumn(out, F.coalesce("_drawn", "_even", F.lit("unknown"))).drop(
        "_u", "_pv", "_slots", "_slot", "_ask", "_pv2", "_drawn", "lo", "hi", "_in", "_even", "_place")


def prior_sample(df: DataFrame, prior: DataFrame, out: str, seed, key: str = ID) -> DataFrame:
    """Draw from one prior (value, prob): the arrays are a scalar subquery, no join."""
    one = sampling_arrays(prior.select(F.lit(0).alias("_g"), F.col("value").alias("child_value"), "prob"), ["_g"])
    packed = one.select(F.struct("cats", "cum").alias("s")).scalar()
    return df.withColumn("_prior", packed).withColumn(
        out, pick(F.col("_prior.cats"), F.col("_prior.cum"), uniform(seed, out, key))).drop("_prior")


# ---- rank correlation -------------------------------------------------------------------------


def square(table: DataFrame, columns: list[str]) -> np.ndarray:
    """A (a, b, value) table as a small matrix: one cell per pair of columns."""
    m = np.eye(len(columns))
    place = {c: i for i, c in enumerate(columns)}
    for row in table.where(F.col("a").isin(*columns) & F.col("b").isin(*columns)).collect():
        m[place[row["a"]], place[row["b"]]] = row["value"]
    return (m + m.T) / 2.0


def factor(m: np.ndarray) -> np.ndarray:
    """Cholesky factor, with a little added to the diagonal when the matrix is not positive definite."""
    bump = 0.0
    while True:
        try:
            return np.linalg.cholesky(m + bump * np.eye(len(m)))
        except np.linalg.LinAlgError:
            bump = max(1e-6, bump * 10)


def mix(columns: list[str], weights: np.ndarray) -> list[Column]:
    return [sum((F.lit(float(w)) * F.col(c) for w, c in zip(row, columns) if w != 0.0), F.lit(0.0)) for row in weights]


def rank_copula_reorder(
    reference: DataFrame, generated: DataFrame, columns: list[str], key: str = ID, exact_latent: bool = False, min_rows: int = 10
) -> DataFrame:
    """Give the generated columns the reference's rank correlation without changing their values.

    Normal scores are mixed by the factor of the target matrix; each column's sorted values are then
    dealt out in the order of the mixed score. With ``exact_latent`` the target is 2 sin(pi rho / 6) and
    the scores are whitened first, which reaches the target more closely. A reference of fewer than
    ``min_rows`` complete rows has no correlation to go by: the rows come back as they are, with a warning.
    """
    complete = drop_incomplete_numeric(reference.select(*columns), columns)
    if len(columns) < 2:
        return generated
    if len(complete.take(min_rows)) < min_rows:
        warnings.warn(f"rows keep their order: the reference has fewer than {min_rows} rows with all of {columns}", stacklevel=2)
        return generated
    target = square(spearman_matrix(complete, columns), columns)
    scored, n = with_normal_scores(generated.select(key, *columns), columns, key)
    weights = factor(2.0 * np.sin(math.pi * target / 6.0) if exact_latent else target)
    if exact_latent:
        one = weighted_covariance(scored, columns, n).first()
        own = np.array([[one[f"v{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
        weights = weights @ np.linalg.inv(factor(own))
    scores = mix([f"z_{c}" for c in columns], weights)
    # The planning scans and the dealing read the scores, so they are written once.
    latent = {c: f"_y{i}" for i, c in enumerate(columns)}
    dealt = materialize(scored.select(key, *[s.alias(y) for s, y in zip(scores, latent.values())]), "scores")
    plans = order_plans(dealt, list(latent.values()), F.xxhash64(F.col(f"`{key}`")))
    whole = generated.na.drop(subset=columns)
    # The runs are read for their starts and ends by every column.
    runs = materialize(run_lengths(whole, columns), "runs")
    # Rows carry their other scores from column to column, so the columns need not be brought together by key.
    for i, (c, y) in enumerate(latent.items()):
        dealt = deal_values(dealt, y, key, plans[y], runs.where(F.col("field") == c), f"_v{i}")
    kinds = dict(generated.dtypes)
    # Rows of one key all get its largest values; a null key gets none.
    held = dealt.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(
        *[F.max(f"_v{i}").cast(kinds[c]).alias(c) for i, c in enumerate(columns)], F.count(F.lit(1)).alias("_n"))
    if set(generated.columns) == {key, *columns}:
        out = held.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    else:
        out = whole.drop(*columns).join(held.drop("_n"), key)
    partial = generated.where(" or ".join(f"`{c}` is null" for c in columns))
    return out.select(*generated.columns).unionByName(partial)


def quantile_position(u: Column, m: Column) -> Column:
    return F.greatest(F.lit(0), F.least(m - 1, F.floor(u * (m - 1)))).cast("long")


def empirical_quantile_map(df: DataFrame, u: str, runs: DataFrame, out: str) -> DataFrame:
    """sorted_reference[floor(u * (m - 1))] for each row; exact, by positions, for any distribution of u."""
    m = runs.agg(F.max("n_total").alias("m")).select("m").scalar()
    return value_at(df.withColumn("_pos", quantile_position(F.col(u), m)), "_pos", runs, out).drop("_pos")


def copula_latents(df: DataFrame, covariance: np.ndarray, columns: list[str], seed, key: str = ID) -> DataFrame:
    """Add ``u_<c>``: correlated uniforms from a Gaussian copula, each latent divided by its own sd."""
    lower = factor(covariance) / np.sqrt(np.diag(covariance))[:, None]
    raw = df.withColumns({f"_z{i}": normal(seed, f"copula/{c}", key) for i, c in enumerate(columns)})
    mixed = raw.withColumns({f"_l{i}": m for i, m in enumerate(mix([f"_z{i}" for i in range(len(columns))], lower))})
    edge = 1e-10
    done = mixed.withColumns({
        f"u_{c}": F.greatest(F.lit(edge), F.least(F.lit(1 - edge), norm_cdf(F.col(f"_l{i}")))) for i, c in enumerate(columns)})
    return done.drop(*[f"_z{i}" for i in range(len(columns))], *[f"_l{i}" for i in range(len(columns))])


def copula_sample(df: DataFrame, covariance: np.ndarray, quantiles: DataFrame, columns: list[str], seed, key: str = ID) -> DataFrame:
    """Columns with the reference's marginals and its normal-score covariance."""
    used = quantiles.where(F.col("field").isin(*columns))
    # One size per column.
    sizes = {r["field"]: r["m"] for r in used.groupBy("field").agg(F.max("n_total").alias("m")).collect()}
    out = copula_latents(df, covariance, columns, seed, key).where(F.col(f"`{key}`").isNotNull() if sizes else F.lit(False))
    # Rows go from column to column with all that they hold, so they are neither made twice nor brought together by key.
    out = out.withColumns({f"u_{c}": quantile_position(F.col(f"u_{c}"), F.lit(sizes.get(c))) for c in columns})
    for c in columns:
        if c in sizes:
            out = values_in_place(out, f"u_{c}", sizes[c], used.where(F.col("field") == c), c)
        else:
            out = out.withColumn(c, F.lit(None).cast("double")).drop(f"u_{c}")
    return out


# ---- whole table ------------------------------------------------------------------------------


def generate_relational(
    spark: SparkSession, spec: TableSpec, priors: Priors, n: int | None = None, seed: int | str = 42, ids: DataFrame | None = None
) -> DataFrame:
    """Columns in dependency order: conditional tables, conditional moments, copula, plain generators."""
    n = spec.n_rows if n is None and ids is None else n
    df = ids.select(ID) if ids is not None else spark.range(max(0, n)).toDF(ID)
    moments = {r["field"]: r for r in priors.numeric.collect()}
    copula: list[str] = []
    made: set[str] = set()
    for name in generation_order(spec):
        f = spec[name]
        if f.type == "category":
            parents = [p for p in category_parents(spec, name) if p in made][:1]
            if parents:
                cpt = priors.conditional_category.where((F.col("parent") == parents[0]) & (F.col("child") == name))
                df = lookup_cpt_sample(df, parents[0], cpt, name, seed)
            else:
                df = prior_sample(df, priors.category.where(F.col("field") == name), name, seed)
        elif f.numeric:
            parents = [p for p in numeric_parents(spec, name) if p in made][:1]
            if not parents:
                copula.append(name)
                continue
            stats = priors.conditional_numeric.where((F.col("parent") == parents[0]) & (F.col("child") == name))
            g = moments.get(name)
            df = lookup_conditional_numeric(
                df, parents[0], stats, (g["mean"], g["std"]) if g else (0.0, 1.0), name, seed, f.min, f.max)
        else:
            df = df.withColumn(name, independent_column(f, spec, seed, F.col(ID), n, "md5"))
        made.add(name)
    known = [c for c in copula if c in moments]
    if len(known) > 1:
        df = copula_sample(df, square(priors.covariance, known), priors.quantiles, known, seed)
        df = df.withColumns({c: clamp(F.col(c), spec[c].min, spec[c].max) for c in known})
    for c in copula:
        if c not in df.columns:
            g = moments.get(c)
            mean, std = (g["mean"], g["std"]) if g else (0.0, 1.0)
            df = df.withColumn(c, clamp(F.lit(float(mean)) + F.lit(float(std)) * normal(seed, c, ID), spec[c].min, spec[c].max))
    ints = {f.name: F.rint(F.col(f.name)).cast("long") for f in spec.fields if f.type == "int"}
    if ints:
        df = df.withColumns(ints)
    return df.select(ID, *spec.names())
