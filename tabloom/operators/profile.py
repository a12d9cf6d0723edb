"""Descriptive statistics, as tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.operators.coerce import coerce_column, number, numeric_columns
from tabloom.functions.special import with_norm_ppf
from tabloom.operators.order import add_rank, cut_points, exact_quantiles, order_plans, prefix_sums
from tabloom.spec import TableSpec


def stack_rows(one_row: DataFrame, rows: list[dict]) -> DataFrame:
    """Turn one aggregate row into several: each dict maps an output column to an expression."""
    structs = [F.struct(*[c.alias(k) for k, c in r.items()]) for r in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def as_long(df: DataFrame, columns: list[str], dtype: str = "string") -> DataFrame:
    """(field, value) with one row per cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast(dtype).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.field", "c.value")


def value_counts(df: DataFrame, columns: list[str], dropna: bool = True) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    cells = as_long(df, columns)
    if dropna:
        cells = cells.where(F.col("value").isNotNull())
    return cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def field_stats(df: DataFrame, approximate: bool = False, rsd: float = 0.02) -> DataFrame:
    """Per column: distinct values (a null counts as one), null share, mean and population std."""
    numeric = set(numeric_columns(df))
    aggs, rows = [], []
    for c in df.columns:
        x = F.col(f"`{c}`")
        distinct = F.approx_count_distinct(x, rsd) if approximate else F.count_distinct(x)
        aggs += [distinct.alias(f"{c}|d"), F.count_if(x.isNull()).alias(f"{c}|z")]
        row = {
            "field": F.lit(c),
            "nunique": F.col(f"`{c}|d`") + (F.col(f"`{c}|z`") > 0).cast("long"),
            "null_frac": F.coalesce(F.try_divide(F.col(f"`{c}|z`").cast("double"), F.col("_rows")), F.lit(0.0)),
            "mean": F.lit(None).cast("double"),
            "std": F.lit(None).cast("double"),
        }
        if c in numeric:
            aggs += [F.avg(x).alias(f"{c}|m"), F.stddev_pop(x).alias(f"{c}|s")]
            row["mean"], row["std"] = F.col(f"`{c}|m`"), F.col(f"`{c}|s`")
        rows.append(row)
    return stack_rows(df.agg(F.count(F.lit(1)).alias("_rows"), *aggs), rows)


def field_stats_validated(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Per specified field after the tolerant cast: nunique without nulls, null share, moments, range."""
    aggs, rows = [], []
    none = F.lit(None).cast("double")
    for f in spec.fields:
        if f.name not in df.columns or not f.supported:
            continue
        x = coerce_column(df, f.name, f.type)
        k = f.name
        aggs += [F.count_distinct(x).alias(f"{k}|d"), F.count_if(x.isNull()).alias(f"{k}|z")]
        row = {
            "field": F.lit(k),
            "nunique": F.col(f"`{k}|d`"),
            "null_frac": F.coalesce(F.try_divide(F.col(f"`{k}|z`").cast("double"), F.col("_rows")), F.lit(0.0)),
            "mean": none, "std": none, "min": none, "max": none,
        }
        if f.numeric:
            for stat, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
                aggs.append(fn(x).cast("double").alias(f"{k}|{stat}"))
                row[stat] = F.col(f"`{k}|{stat}`")
        rows.append(row)
    return stack_rows(df.agg(F.count(F.lit(1)).alias("_rows"), *aggs), rows)


def category_prior(df: DataFrame, column: str, categories=None, alpha: float = 1.0, null_as: str | None = None) -> DataFrame:
    """(field, value, n, prob): Dirichlet-smoothed shares over the given or the observed categories.

    ``null_as`` counts nulls as a category of that name; otherwise they are left out.
    """
    x = F.col(column).cast("string")
    source = df.withColumn("_x", F.coalesce(x, F.lit(null_as)) if null_as else x).where(F.col("_x").isNotNull())
    counts = source.groupBy(F.col("_x").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if categories:
        wanted = df.sparkSession.createDataFrame([(str(c),) for c in categories], "value string")
        counts = wanted.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = counts.agg(F.sum(F.col("n") + F.lit(float(alpha))).alias("t"))
    return counts.select(
        F.lit(column).alias("field"), "value", "n",
        F.try_divide(F.col("n") + F.lit(float(alpha)), total.select("t").scalar()).alias("prob"),
    )


def empirical_category_probs(df: DataFrame, column: str, categories=None) -> DataFrame:
    return category_prior(df, column, categories, alpha=0.0)


def global_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, mean, std, min, max); no values give 0, 1, 0, 1 and a zero std gives 1e-9."""
    aggs, rows = [], []
    for c in columns:
        x = number(df, c)
        aggs += [F.count(x).alias(f"{c}|n"), F.avg(x).alias(f"{c}|mean"), F.stddev_pop(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
        some = F.col(f"`{c}|n`") > 0
        std = F.col(f"`{c}|std`")
        rows.append({
            "field": F.lit(c),
            "mean": F.when(some, F.col(f"`{c}|mean`")).otherwise(0.0),
            "std": F.when(~some, 1.0).when(std == 0, 1e-9).otherwise(std),
            "min": F.when(some, F.col(f"`{c}|min`")).otherwise(0.0),
            "max": F.when(some, F.col(f"`{c}|max`")).otherwise(1.0),
        })
    return stack_rows(df.agg(*aggs), rows)


def conditional_numeric(df: DataFrame, pairs: list[tuple[str, str]], min_samples: int = 10, zero_std: float = 1e-9) -> DataFrame:
    """(parent, parent_value, child, n, mean, std) for several (parent, child) pairs in one pass.

    Groups below ``min_samples`` keep their count with null moments and ``enough`` = 0.
    """
    cells = F.array(*[
        F.struct(
            F.lit(p).alias("parent"), F.col(f"`{p}`").cast("string").alias("parent_value"),
            F.lit(c).alias("child"), number(df, c).alias("x"))
        for p, c in pairs
    ])
    g = (
        df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("parent_value").isNotNull())
        .groupBy("parent", "parent_value", "child")
        .agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    )
    enough = F.col("n") >= min_samples
    return g.select(
        "parent", "parent_value", "child", "n",
        F.when(enough, F.col("m")).alias("mean"),
        F.when(enough, F.when(F.col("s") == 0, F.lit(zero_std)).otherwise(F.col("s"))).alias("std"),
        enough.cast("int").alias("enough"),
    )


def conditional_numeric_drivers(df: DataFrame, spec: TableSpec, drivers, min_samples: int = 10) -> DataFrame:
    """The same for the automatic drivers; small groups are left out and a zero std becomes 1."""
    parents = [c for c in drivers if c in spec.names("category") and c in df.columns]
    pairs = [(p, c) for p in parents for c in spec.names("int", "float") if c in df.columns]
    return conditional_numeric(df, pairs, min_samples, zero_std=1.0).where("enough = 1").drop("enough")


def conditional_category_sparse(df: DataFrame, parent: str, child: str, alpha: float = 1.0, null_as: str = "__null__") -> DataFrame:
    """P(child | parent) with Dirichlet smoothing, without the pairs that never occur.

    Observed pairs have a row each; a row with a null child holds, per parent, the share of every child not seen with it. What
    grows with the parents times the children is never made.
    """
    value = F.coalesce(F.col(child).cast("string"), F.lit(null_as)).alias("child_value")
    pairs = df.where(F.col(parent).isNotNull()).groupBy(F.col(parent).cast("string").alias("parent_value"), value).agg(F.count(F.lit(1)).alias("n"))
    k = df.select(value).distinct().agg(F.count(F.lit(1)).alias("k")).select("k").scalar()
    totals = pairs.groupBy("parent_value").agg(F.sum("n").alias("samples"))
    rows = pairs.join(totals, "parent_value").unionByName(
        totals.select("parent_value", F.lit(None).cast("string").alias("child_value"), F.lit(0).cast("long").alias("n"), "samples"))
    return rows.select(
        F.lit(parent).alias("parent"), "parent_value", F.lit(child).alias("child"), "child_value", "samples",
        ((F.col("n") + F.lit(float(alpha))) / (F.col("samples") + k * F.lit(float(alpha)))).alias("prob"))


#: Groups that the child values are dealt to when a whole table of parents and children is written out.
CHILD_GROUPS = 64


def conditional_category_table(df: DataFrame, parent: str, child: str, alpha: float = 1.0, null_as: str = "__null__") -> DataFrame:
    """P(child | parent) with Dirichlet smoothing over all child values, one row for every parent and child.

    The sparse table gives the shares; parents meet the child values group by group, so no list of values is held anywhere.
    """
    sparse = conditional_category_sparse(df, parent, child, alpha, null_as)
    group = F.pmod(F.xxhash64("child_value"), F.lit(CHILD_GROUPS))
    children = df.select(F.coalesce(F.col(child).cast("string"), F.lit(null_as)).alias("child_value")).distinct().withColumn("_g", group)
    rest = sparse.where("child_value IS NULL").drop("child_value").withColumnRenamed("prob", "_rest")
    grid = rest.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHILD_GROUPS - 1).cast("long")))).join(children, "_g").drop("_g")
    seen = sparse.where("child_value IS NOT NULL").select("parent_value", "child_value", "prob")
    return grid.join(seen, ["parent_value", "child_value"], "left").select(
        "parent", "parent_value", "child", "child_value", "samples", F.coalesce("prob", "_rest").alias("prob"))


def role_salary_from_table(df: DataFrame, role: str = "role", salary: str = "salary") -> DataFrame:
    """Per role the mean and the sample std, null read as 0 and then a zero std as 1."""
    g = df.where(F.col(role).isNotNull()).groupBy(F.col(role).cast("string").alias("role")).agg(
        F.coalesce(F.avg(salary), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(salary), F.lit(0.0)).alias("std"),
    )
    return g.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def class_balance(df: DataFrame, label, target: float, tolerance: float = 0.01) -> DataFrame:
    lab = label if isinstance(label, Column) else F.col(label)
    share = F.avg(F.coalesce(lab == 1, F.lit(False)).cast("int"))
    return df.agg(share.alias("share")).select(
        "share", F.lit(float(target)).alias("target"),
        (F.abs(F.col("share") - F.lit(float(target))) <= F.lit(tolerance + 1e-9)).cast("int").alias("ok"),
    )


def group_mean_spread(df: DataFrame, group: str, value: str, weak_below: float = 0.05) -> DataFrame:
    """(max - min) / min of the group means; ``weak`` marks a spread below the limit."""
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("m"))
    agg = means.agg(F.count("m").alias("n_groups"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    spread = (F.col("hi") - F.col("lo")) / (F.col("lo") + F.lit(1e-9))
    return agg.select(
        "n_groups", spread.alias("spread"),
        ((F.col("n_groups") >= 2) & (spread < F.lit(weak_below))).cast("int").alias("weak"),
    )


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.round(F.avg(value), 2).alias("mean"), F.round(F.stddev_samp(value), 2).alias("std"),
        F.round(F.min(value), 2).alias("min"), F.round(F.max(value), 2).alias("max"),
    )


def share_by_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n, percent); the per-field totals are one row per column."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "field").select(
        "field", "value", "n",
        F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), F.col("total")), F.lit(0.0)).alias("percent"),
    )


def median_and_range(df: DataFrame, columns: list[str], dates: list[str] = (), approximate: bool = False) -> DataFrame:
    """Mean, sample std, min, max and median of numeric columns; first and last moment of dates."""
    aggs, rows = [], []
    none, no_time = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    for c in columns:
        x = F.col(c).cast("double")
        stats = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        if approximate:
            stats["median"] = F.percentile_approx(x, 0.5, 10000)
        aggs += [v.alias(f"{c}|{k}") for k, v in stats.items()]
        rows.append({"field": F.lit(c), **{k: F.col(f"`{c}|{k}`") for k in stats}, "first": no_time, "last": no_time})
    for c in dates:
        aggs += [F.min(c).cast("timestamp_ntz").alias(f"{c}|first"), F.max(c).cast("timestamp_ntz").alias(f"{c}|last")]
        rows.append({"field": F.lit(c), "mean": none, "std": none, "min": none, "max": none,
                     **({"median": none} if approximate else {}),
                     "first": F.col(f"`{c}|first`"), "last": F.col(f"`{c}|last`")})
    out = stack_rows(df.agg(*aggs), rows)
    if not approximate and columns:
        out = out.join(F.broadcast(exact_quantiles(df, list(columns), 0.5)), "field", "left").withColumnRenamed("q_value", "median")
    return out.select("field", "mean", "std", "min", "max", "median", "first", "last")


def subset_profile(df: DataFrame, flag: Column, averages: list[str], category: str, top: int = 3) -> DataFrame:
    """Averages on flagged rows and the flagged rows' most frequent categories."""
    subset = df.where(flag)
    means = stack_rows(
        subset.agg(*[F.avg(c).alias(c) for c in averages]),
        [{"metric": F.lit("mean"), "name": F.lit(c), "value": F.col(c)} for c in averages],
    )
    best = (
        subset.groupBy(F.col(category).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "name").limit(top)
        .select(F.lit("top_category").alias("metric"), "name", F.col("n").cast("double").alias("value"))
    )
    return means.unionByName(best)


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key, rows beyond the first per whole row, and null cells."""
    def beyond_first(cols):
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(
            (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("x"))

    nulls = df.agg(F.coalesce(F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))), F.lit(0)).alias("null_cells"))
    return nulls.select(
        beyond_first(keys).select("x").scalar().cast("long").alias("duplicate_keys"),
        beyond_first(df.columns).select("x").scalar().cast("long").alias("duplicate_rows"),
        F.col("null_cells").cast("long"),
    )


def skew_kurtosis(df: DataFrame, columns: list[str], max_skew: float = 2.0, max_kurtosis: float = 7.0) -> DataFrame:
    """Biased skewness and excess kurtosis; flagged when extreme and backed by more than 3 values."""
    aggs, rows = [], []
    for c in columns:
        x = number(df, c)
        aggs += [F.count(x).alias(f"{c}|n"), F.skewness(x).alias(f"{c}|s"), F.kurtosis(x).alias(f"{c}|k")]
        enough = F.col(f"`{c}|n`") > 3

        def flag(v, limit):
            return F.coalesce(enough & ~F.isnan(v) & (F.abs(v) > F.lit(limit)), F.lit(False)).cast("int")

        rows.append({
            "field": F.lit(c), "n": F.col(f"`{c}|n`"),
            "skewness": F.col(f"`{c}|s`"), "kurtosis": F.col(f"`{c}|k`"),
            "high_skew": flag(F.col(f"`{c}|s`"), max_skew), "high_kurtosis": flag(F.col(f"`{c}|k`"), max_kurtosis),
        })
    return stack_rows(df.agg(*aggs), rows)


def entropy_top_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, entropy in bits, share of the most frequent value)."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(totals), "field").groupBy("field").agg(
        (-F.sum(p * F.log2(p))).alias("entropy"), F.max(p).alias("top_share"))


def realism_quick_score(df: DataFrame, spec: TableSpec, role: str = "role", salary: str = "salary") -> DataFrame:
    """1.0, times 0.9 for every extreme skew, extreme kurtosis, dominant category or flat role-salary link."""
    numeric = [c for c in spec.names("int", "float") if c in df.columns]
    cats = [c for c in spec.names("category") if c in df.columns]
    flags = []
    if numeric:
        flags.append(skew_kurtosis(df, numeric).select(
            F.col("high_skew").alias("a"), F.col("high_kurtosis").alias("b")))
    if cats:
        flags.append(entropy_top_share(df, cats).select(
            (F.col("top_share") > 0.9).cast("int").alias("a"), F.lit(0).alias("b")))
    if role in df.columns and salary in df.columns:
        flags.append(group_mean_spread(df, role, salary).select(F.col("weak").alias("a"), F.lit(0).alias("b")))
    if not flags:
        return df.sparkSession.createDataFrame([(0, 1.0)], "n_flags long, score double")
    union = flags[0]
    for extra in flags[1:]:
        union = union.unionByName(extra)
    return union.agg(F.sum(F.col("a") + F.col("b")).alias("n_flags")).select(
        "n_flags", F.pow(F.lit(0.9), F.col("n_flags").cast("double")).alias("score"))


# ---- correlation ------------------------------------------------------------------------------


def with_ranks(df: DataFrame, columns: list[str], key: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(rows with ``rank_<c>`` and weight ``_w``, number of values per column).

    With a unique ``key`` the rows stay single rows and a null gets no rank. Without one, incomplete rows
    are dropped and equal rows are counted first, which is all that a correlation needs.
    """
    if key:
        base = df
        rows = df.withColumn("_w", F.lit(1).cast("long"))
    else:
        base = df.select(*columns).na.drop()
        rows = base.groupBy(*columns).agg(F.count(F.lit(1)).alias("_w"))
    salt = F.xxhash64(key) if key else F.xxhash64(*columns)
    plans = order_plans(base, columns, salt)
    for c in columns:
        rows = add_rank(rows, c, plans[c], salt, f"rank_{c}", "_w")
    return rows, {c: p.total for c, p in plans.items()}


def rank_correlation(ranked: DataFrame, n: dict[str, int], pairs: list[tuple[str, str]], names: list[str], *extra) -> DataFrame:
    """One row with the weighted correlation of each pair of ranks; undefined is null.

    Ranks are centred on their known mean (n + 1) / 2 before they are multiplied.
    """
    w = F.col("_w")
    used = sorted({c for p in pairs for c in p})
    centred = ranked.withColumns({f"_d_{c}": F.col(f"rank_{c}") - F.lit((n[c] + 1) / 2.0) for c in used})
    sums = centred.agg(
        F.sum(w).alias("_rows"),
        *[F.sum(w * F.col(f"_d_{a}") * F.col(f"_d_{b}")).alias(f"_ab{i}") for i, (a, b) in enumerate(pairs)],
        *[F.sum(w * F.col(f"_d_{c}") * F.col(f"_d_{c}")).alias(f"_ss_{c}") for c in used], *extra)
    rho = [
        F.try_divide(F.col(f"_ab{i}"), F.sqrt(F.col(f"_ss_{a}")) * F.sqrt(F.col(f"_ss_{b}"))).alias(name)
        for i, ((a, b), name) in enumerate(zip(pairs, names))]
    done = ["_rows"] + [f"_ab{i}" for i in range(len(pairs))] + [f"_ss_{c}" for c in used]
    return sums.select("*", *rho).drop(*done)


def matrix_rows(one_row: DataFrame, columns: list[str], cell) -> DataFrame:
    """(a, b, value) for all ordered pairs of one aggregate row; ``cell`` maps (i, j), i <= j, to an expression."""
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            rows.append({"a": F.lit(a), "b": F.lit(b), "value": cell(min(i, j), max(i, j))})
    return stack_rows(one_row, rows)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): symmetric rank correlation, 1 on the diagonal, undefined read as 0."""
    ranked, n = with_ranks(df, columns)
    places = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    one = rank_correlation(ranked, n, [(columns[i], columns[j]) for i, j in places], [f"r{i}_{j}" for i, j in places])
    return matrix_rows(one, columns, lambda i, j: F.lit(1.0) if i == j else F.coalesce(F.col(f"r{i}_{j}"), F.lit(0.0)))


def with_normal_scores(df: DataFrame, columns: list[str], key: str | None = None) -> tuple[DataFrame, int]:
    """:func:`with_ranks` of complete rows plus ``z_<c>``, the inverse normal of (rank - 0.5) / n.

    The share is kept inside (1e-10, 1 - 1e-10); the second result is the number of rows.
    """
    df = df.na.drop(subset=columns)
    ranked, n = with_ranks(df, columns, key)
    edge = 1e-10
    p = {
        f"z_{c}": F.greatest(F.lit(edge), F.least(F.lit(1 - edge), (F.col(f"rank_{c}") - F.lit(0.5)) / F.lit(float(max(n[c], 1)))))
        for c in columns}
    return with_norm_ppf(ranked, p), n[columns[0]]


def rank_matrices(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, spearman, covariance): both matrices from one ranking of the columns."""
    scored, n = with_normal_scores(df.select(*columns), columns)
    places = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    totals = {c: n for c in columns}
    rho = rank_correlation(scored, totals, [(columns[i], columns[j]) for i, j in places], [f"r{i}_{j}" for i, j in places],
                           *weighted_sums(columns))
    one = rho.select(*[f"r{i}_{j}" for i, j in places], *covariance_cells(columns, n))
    rows = [
        {"a": F.lit(a), "b": F.lit(b),
         "spearman": F.lit(1.0) if i == j else F.coalesce(F.col(f"r{min(i, j)}_{max(i, j)}"), F.lit(0.0)),
         "covariance": F.coalesce(F.col(f"v{min(i, j)}_{max(i, j)}"), F.lit(1.0 if i == j else 0.0))}
        for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return stack_rows(one, rows)


def weighted_sums(columns: list[str], prefix: str = "z_") -> list:
    w = F.col("_w")
    return [
        *[F.sum(w * F.col(f"{prefix}{columns[i]}") * F.col(f"{prefix}{columns[j]}")).alias(f"p{i}_{j}")
          for i in range(len(columns)) for j in range(i, len(columns))],
        *[F.sum(w * F.col(f"{prefix}{c}")).alias(f"s{i}") for i, c in enumerate(columns)]]


def covariance_cells(columns: list[str], n: int) -> list:
    total, less = F.lit(float(n)), F.lit(float(n - 1))
    return [
        F.try_divide(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / total, less).alias(f"v{i}_{j}")
        for i in range(len(columns)) for j in range(i, len(columns))]


def weighted_covariance(scored: DataFrame, columns: list[str], n: int) -> DataFrame:
    """One row with the sample covariance ``v<i>_<j>`` of the weighted normal scores."""
    return scored.agg(*weighted_sums(columns)).select(*covariance_cells(columns, n))


def gaussian_covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): sample covariance of the normal scores."""
    scored, n = with_normal_scores(df.select(*columns), columns)
    one = weighted_covariance(scored, columns, n)
    return matrix_rows(one, columns, lambda i, j: F.coalesce(F.col(f"v{i}_{j}"), F.lit(1.0 if i == j else 0.0)))


def corr_heatmap_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation with a grey level: min-max scaled to 0..255, high correlation dark."""
    m = spearman_matrix(df, columns)
    rng = m.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    unit = (F.col("value") - lo) / (hi - lo + F.lit(1e-9))
    return m.select("a", "b", F.col("value").alias("rho"), (F.lit(255.0) - unit * F.lit(255.0)).alias("scaled"))


# ---- chart tables -----------------------------------------------------------------------------


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(field, bin, n) with equal-width bins, the last one closed; empty bins are left out."""
    bounds = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns])
    cells = []
    for c in columns:
        b = bounds.select(c).scalar()
        lo, hi = b["lo"], b["hi"]
        # A constant column gets unit width around the value.
        flat = lo == hi
        low, width = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, F.lit(1.0)).otherwise(hi - lo) / F.lit(float(bins))
        slot = F.least(F.floor((F.col(c).cast("double") - low) / width), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("field"), slot.alias("bin")))
    return (
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("bin").isNotNull())
        .groupBy("field", "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def bar_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, columns)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n_codes): 0-based position of each distinct text in sorted order."""
    seen = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    cuts = cut_points(seen, ["value"])["value"]
    return prefix_sums(seen.withColumn("one", F.lit(1)), "value", ["one"], cuts).select(
        "value", F.col("one_before").alias("code"), F.col("one_total").alias("n_codes"))


def density_grid(df: DataFrame, category: str, value: str, width: int = 600, height: int = 400, margin: int = 10) -> DataFrame:
    """(x, y, n) of the category code against the scaled value on a pixel grid.

    Rows collapse to (category, y) cells before the codes are joined.
    """
    v = F.coalesce(number(df, value), F.lit(0.0))
    facts = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = facts.select("lo").scalar(), facts.select("hi").scalar()
    unit = F.when(hi == lo, F.lit(0.0)).otherwise((v - lo) / (hi - lo))
    y = F.floor(F.lit(float(height - margin)) - unit * F.lit(float(height - margin))).cast("int")
    cells = (
        df.where(F.col(category).isNotNull())
        .groupBy(F.col(category).cast("string").alias("value"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    )
    x = F.floor(F.col("code") / F.greatest(F.lit(1), F.col("n_codes") - 1) * F.lit(float(width - margin))).cast("int")
    return cells.join(category_codes(df, category), "value").groupBy(x.alias("x"), "y").agg(F.sum("n").alias("n"))


def label_share(df: DataFrame, label: str) -> DataFrame:
    return entropy_top_share(df, [label]).select(F.col("field").alias("label"), "top_share")


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
