"""How close a generated table is to a reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabloom.functions.special import chi2_sf, kolmogorov_pvalue
from tabloom.operators.coerce import number
from tabloom.operators.order import cut_points, prefix_sums
from tabloom.operators.profile import rank_correlation, stack_rows, with_ranks
from tabloom.sources.runtime import materialize

# Weights of the contribution and of the composite score.
NUM_CONTRIB = (0.5, 0.3, 0.2)
CAT_CONTRIB = (0.5, 0.3, 0.2)
NUM_SCORE = (0.4, 0.3, 0.3)
CAT_SCORE = (0.5, 0.3, 0.2)
BLEND = (0.6, 0.4)


def _numeric_cells(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("field"), number(df, c).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.field", "c.value").where(F.col("value").isNotNull())


def reference_facts(reference: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """What every comparison asks of a reference, written once: counts per value, cuts, moments, largest shares."""
    facts: dict = {"cuts": {}}
    if numeric:
        counts = _numeric_cells(reference, numeric).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
        facts["counts"], facts["cuts"] = materialize(counts, "counts"), cut_points(reference, numeric)
        facts["moments"] = materialize(side_moments(reference, reference, numeric).select("field", "std_ref"), "moments")
    if categorical:
        facts["shares"] = materialize(topk_shares(reference, categorical).select("field", "value", "share"), "shares")
    return facts


def empirical_steps(samples: DataFrame, reference: DataFrame, columns: list[str], candidates: int = 1, candidate: str | None = None,
                    facts: dict | None = None) -> DataFrame:
    """Empirical CDFs of the reference (``r``) and of every sample (``g0``, ``g1``, ...) per column.

    One row per distinct value with running counts and the next larger value. ``candidate`` numbers the
    samples 0..candidates-1; they become weight columns, so the reference is counted and ordered once
    whatever their number; with ``facts`` its counts and cuts are read instead.
    """
    names = [f"g{i}" for i in range(candidates)]
    tag = F.col(candidate).cast("int") if candidate else F.lit(0)
    cells = _numeric_cells(samples.withColumn("_tag", tag), columns, ["_tag"]).withColumn("n", F.lit(1).cast("long"))
    if facts:
        known = facts["counts"].select(F.lit(-1).alias("_tag"), "field", "value", "n")
    else:
        known = _numeric_cells(reference.withColumn("_tag", F.lit(-1)), columns, ["_tag"]).withColumn("n", F.lit(1).cast("long"))
    counts = cells.unionByName(known).groupBy("field", "value").agg(
        *[F.coalesce(F.sum(F.when(F.col("_tag") == i, F.col("n"))), F.lit(0)).alias(n) for i, n in [*enumerate(names), (-1, "r")]])
    cuts_g, cuts_r = cut_points(samples, columns), facts["cuts"] if facts else cut_points(reference, columns)
    cuts = {c: sorted(set(cuts_g[c]) | set(cuts_r[c])) for c in columns}
    return prefix_sums(counts, "value", [*names, "r"], cuts, group="field", neighbours=True)


def ks_and_emd_many(samples: DataFrame, reference: DataFrame, columns: list[str], candidates: int = 1, candidate: str | None = None,
                    facts: dict | None = None) -> DataFrame:
    """(candidate, field, n_gen, n_ref, ks_stat, ks_pvalue, emd) for every numbered sample."""
    steps = empirical_steps(samples, reference, columns, candidates, candidate, facts)
    width = F.col("next") - F.col("value")
    fr = (F.col("r_before") + F.col("r")) / F.col("r_total")
    aggs = [F.max("r_total").alias("n_ref")]
    for i in range(candidates):
        gap = F.abs(F.try_divide(F.col(f"g{i}_before") + F.col(f"g{i}"), F.col(f"g{i}_total")) - fr)
        aggs += [F.max(f"g{i}_total").alias(f"n{i}"), F.max(gap).alias(f"k{i}"), F.coalesce(F.sum(gap * width), F.lit(0.0)).alias(f"e{i}")]
    one = steps.groupBy("field").agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.col(f"n{i}").alias("n_gen"), F.col(f"k{i}").alias("ks_stat"), F.col(f"e{i}").alias("emd"))
        for i in range(candidates)])
    return (
        one.select("field", "n_ref", F.explode(cells).alias("c")).select("field", "n_ref", "c.*")
        .where("n_gen > 0 and n_ref > 0")
        .withColumn("ks_pvalue", kolmogorov_pvalue(F.col("ks_stat"), F.col("n_gen").cast("double"), F.col("n_ref").cast("double")))
        .select("candidate", "field", "n_gen", "n_ref", "ks_stat", "ks_pvalue", "emd")
    )


def ks_and_emd(generated: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_gen, n_ref, ks_stat, ks_pvalue, emd) in one pass over the distinct values."""
    return ks_and_emd_many(generated, reference, columns).drop("candidate")


def ks_two_sample(generated, reference, columns) -> DataFrame:
    return ks_and_emd(generated, reference, columns).drop("emd")


def wasserstein_1d(generated, reference, columns) -> DataFrame:
    return ks_and_emd(generated, reference, columns).select("field", "emd")


def align_pairs(generated: DataFrame, reference: DataFrame, columns: list[str], key: str | None) -> DataFrame:
    """Rows of both sides with the same key; positional pairing has no meaning without one."""
    if not key:
        raise ValueError("pairing needs an explicit row key")
    g = generated.select(key, *[F.col(c).alias(f"gen_{c}") for c in columns])
    r = reference.select(key, *[F.col(c).alias(f"ref_{c}") for c in columns])
    return g.join(r, key)


def paired_spearman(generated: DataFrame, reference: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(field, rho): rank correlation of the paired values; undefined read as 0."""
    pairs = align_pairs(generated, reference, columns, key)
    masked = {}
    for c in columns:
        both = F.col(f"gen_{c}").isNotNull() & F.col(f"ref_{c}").isNotNull()
        masked.update({f"{side}_{c}": F.when(both, F.col(f"{side}_{c}").cast("double")) for side in ("gen", "ref")})
    # The joined pairs are read by two planning scans and the ranking, so they are written once.
    pairs = materialize(pairs.select(key, *[v.alias(k) for k, v in masked.items()]), "pairs")
    ranked, n = with_ranks(pairs, list(masked), key)
    one = rank_correlation(ranked, n, [(f"gen_{c}", f"ref_{c}") for c in columns], list(columns))
    return stack_rows(one, [{"field": F.lit(c), "rho": F.coalesce(F.col(f"`{c}`"), F.lit(0.0))} for c in columns])


def side_moments(generated: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """(field, mean_gen, mean_ref, std_ref): one aggregate per side."""
    g = stack_rows(generated.agg(*[F.avg(number(generated, c)).alias(c) for c in columns]),
                   [{"field": F.lit(c), "mean_gen": F.col(f"`{c}`")} for c in columns])
    r = stack_rows(
        reference.agg(*[F.struct(F.avg(number(reference, c)).alias("m"), F.stddev_pop(number(reference, c)).alias("s")).alias(c) for c in columns]),
        [{"field": F.lit(c), "mean_ref": F.col(f"`{c}`.m"), "std_ref": F.col(f"`{c}`.s")} for c in columns])
    return g.join(F.broadcast(r), "field")


def realism_numeric(generated: DataFrame, reference: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """Means, KS, p, EMD, rank correlation (null without a key), contribution and score per column.

    Columns without values on one side keep their row with null metrics. Every part has one row per
    column, so the joins between the parts are tiny.
    """
    base = side_moments(generated, reference, columns)
    out = base.join(F.broadcast(ks_and_emd(generated, reference, columns)), "field", "left")
    if key:
        out = out.join(F.broadcast(paired_spearman(generated, reference, columns, key)), "field", "left")
    else:
        out = out.withColumn("rho", F.lit(None).cast("double"))
    scale = (F.col("std_ref") + F.lit(1e-9)) * F.lit(3.0)
    emd_norm = F.least(F.lit(1.0), F.col("emd") / scale)
    decay = F.exp(-F.col("emd") / scale)
    ks = F.col("ks_stat")
    if key:
        contrib = NUM_CONTRIB[0] * ks + NUM_CONTRIB[1] * emd_norm + NUM_CONTRIB[2] * (1 - F.abs("rho"))
        score = NUM_SCORE[0] * (1 - ks) + NUM_SCORE[1] * decay + NUM_SCORE[2] * F.abs("rho")
    else:
        contrib = (NUM_CONTRIB[0] * ks + NUM_CONTRIB[1] * emd_norm) / F.lit(NUM_CONTRIB[0] + NUM_CONTRIB[1])
        score = (NUM_SCORE[0] * (1 - ks) + NUM_SCORE[1] * decay) / F.lit(NUM_SCORE[0] + NUM_SCORE[1])
    return out.select(
        "field", "mean_gen", "mean_ref", "std_ref", "ks_stat", "ks_pvalue", "emd", "rho",
        contrib.alias("contribution"), score.alias("score"))


# ---- categories -------------------------------------------------------------------------------


def topk_shares(df: DataFrame, columns: list[str], k: int = 10, null_as: str = "__null__", keep: list[str] = ()) -> DataFrame:
    """(keep..., field, value, n, share): the k most frequent values per column, shares within them."""
    cells = df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_as)).alias("value"))
        for c in columns])).alias("c")).select(*keep, "c.*")
    counts = cells.groupBy(*keep, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keep, "field").orderBy(F.desc("n"), "value")
    best = counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return best.select(*keep, "field", "value", "n",
                       (F.col("n") / F.sum("n").over(Window.partitionBy(*keep, "field"))).alias("share"))


def topk_pairs(generated: DataFrame, reference: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(field, value, p, q): both top-k lists side by side, absent shares 0 (at most 2k rows per column)."""
    g = topk_shares(generated, columns, k).select("field", "value", F.col("share").alias("p"))
    r = topk_shares(reference, columns, k).select("field", "value", F.col("share").alias("q"))
    return g.join(r, ["field", "value"], "full_outer").select(
        "field", "value", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def pair_statistics(pairs: DataFrame, by: list[str] = ("field",), total: float = 1e5) -> DataFrame:
    """(by..., top_k_overlap, js_divergence, chi2, dof, pvalue) from :func:`topk_pairs`, in one grouping.

    Jensen-Shannon over the smoothed shares (natural log); chi-square over the shares scaled to counts. A
    value that rounds to zero on both sides makes that table invalid: statistic null, p-value 0.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    eps = F.lit(1e-12)
    rows = pairs.withColumns({"_p": F.col("p") + eps, "_q": F.col("q") + eps, "_o1": F.rint(F.col("p") * F.lit(total)), "_o2": F.rint(F.col("q") * F.lit(total))})
    rows = rows.withColumns({f"_sum{c}": F.sum(c).over(w) for c in ("_p", "_q", "_o1", "_o2")})
    rows = rows.withColumns({"_a": F.col("_p") / F.col("_sum_p"), "_b": F.col("_q") / F.col("_sum_q"), "_col": F.col("_o1") + F.col("_o2"), "_all": F.col("_sum_o1") + F.col("_sum_o2")})
    m = (F.col("_a") + F.col("_b")) / F.lit(2.0)
    js = F.lit(0.5) * (F.col("_a") * F.ln(F.col("_a") / m) + F.col("_b") * F.ln(F.col("_b") / m))
    rows = rows.withColumns({"_js": js, "_e1": F.col("_sum_o1") * F.col("_col") / F.col("_all"), "_e2": F.col("_sum_o2") * F.col("_col") / F.col("_all")})

    def term(o, e):
        return F.try_divide((F.col(o) - F.col(e)) * (F.col(o) - F.col(e)), F.col(e))

    g = rows.groupBy(*by).agg(
        (F.count_if((F.col("p") > 0) & (F.col("q") > 0)) / F.count(F.lit(1))).alias("top_k_overlap"),
        F.sum("_js").alias("js_divergence"),
        F.sum(term("_o1", "_e1") + term("_o2", "_e2")).alias("_chi2"),
        F.count(F.lit(1)).alias("_k"), F.count_if(F.col("_col") > 0).alias("_valid"))
    ok, dof = F.col("_k") == F.col("_valid"), F.col("dof")
    return g.withColumn("dof", (F.col("_k") - 1).cast("int")).select(
        *by, "top_k_overlap", "js_divergence", F.when(ok, F.col("_chi2")).alias("chi2"), "dof",
        F.when(~ok, F.lit(0.0)).when(dof == 0, F.lit(1.0)).otherwise(chi2_sf(F.col("_chi2"), dof)).alias("pvalue"))


def topk_overlap_js(pairs: DataFrame, by: list[str] = ("field",)) -> DataFrame:
    return pair_statistics(pairs, by).select(*by, "top_k_overlap", "js_divergence")


def contingency_chi2(pairs: DataFrame, by: list[str] = ("field",)) -> DataFrame:
    return pair_statistics(pairs, by).select(*by, "chi2", "dof", "pvalue")


def category_score():
    """Score of one category column from its :func:`pair_statistics`."""
    return (CAT_SCORE[0] * (1 - F.least(F.lit(1.0), F.col("js_divergence"))) + CAT_SCORE[1] * F.col("top_k_overlap")
            + CAT_SCORE[2] * F.col("pvalue"))


def realism_categorical(generated: DataFrame, reference: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(field, top_k_overlap, js_divergence, chi2_pvalue, contribution, score) per category column."""
    js, top, p = F.col("js_divergence"), F.col("top_k_overlap"), F.col("pvalue")
    return pair_statistics(topk_pairs(generated, reference, columns, k)).select(
        "field", "top_k_overlap", "js_divergence", p.alias("chi2_pvalue"),
        (CAT_CONTRIB[0] * js + CAT_CONTRIB[1] * (1 - top) + CAT_CONTRIB[2] * (1 - p)).alias("contribution"),
        category_score().alias("score"))


# ---- totals -----------------------------------------------------------------------------------


def _contributions(generated, reference, numeric, categorical, key) -> DataFrame:
    parts = []
    if numeric:
        parts.append(realism_numeric(generated, reference, numeric, key).select(
            "field", F.lit("numeric").alias("kind"), "contribution", "score"))
    if categorical:
        parts.append(realism_categorical(generated, reference, categorical).select(
            "field", F.lit("categorical").alias("kind"), "contribution", "score"))
    if not parts:
        return generated.sparkSession.createDataFrame([], "field string, kind string, contribution double, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def composite(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., numeric_score, categorical_score, composite_score) from (kind, score) rows; a missing kind is 0.5."""
    g = rows.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("kind") == "numeric", F.col("score"))), F.lit(0.5)).alias("numeric_score"),
        F.coalesce(F.avg(F.when(F.col("kind") == "categorical", F.col("score"))), F.lit(0.5)).alias("categorical_score"))
    blend = BLEND[0] * F.col("numeric_score") + BLEND[1] * F.col("categorical_score")
    return g.withColumn("composite_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)) * F.lit(100.0))


def realism_composite(generated: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str], key: str | None = None) -> DataFrame:
    return composite(_contributions(generated, reference, numeric, categorical, key))


def feature_ranking(generated: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str], key: str | None = None, top: int = 10) -> DataFrame:
    """The most divergent columns first."""
    rows = _contributions(generated, reference, numeric, categorical, key).where(F.col("contribution").isNotNull())
    best = rows.orderBy(F.desc("contribution"), "field").limit(top)
    return best.select("field", "kind", "contribution")
