"""The whole run as lazy tables: generate, validate, score, explain, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators import learn, privacy, profile, realism, relational, sweep, tables, utility, validate
from tabloom.operators.generate import ID, generate
from tabloom.plans.enrich import enrich
from tabloom.sources.runtime import materialize
from tabloom.sources.tables import table_fingerprint
from tabloom.spec import TableSpec


def generate_table(
    spark: SparkSession, spec: TableSpec, seed: int | str = 42, n: int | None = None, reference: DataFrame | None = None,
    relational_mode: bool = False, rank_copula: bool = False, min_samples: int = 20, alpha: float = 1.0,
) -> DataFrame:
    """Plain or learned generation; errors surface, nothing falls back silently."""
    if relational_mode:
        if reference is None:
            raise ValueError("learned generation needs a reference table")
        return relational.generate_relational(spark, spec, learn.learn_priors(reference, spec, min_samples, alpha), n, seed)
    df = generate(spark, spec, seed, n)
    numeric = [c for c in spec.names("int", "float") if reference is not None and c in reference.columns]
    return relational.rank_copula_reorder(reference, df, numeric) if rank_copula and numeric else df


def run(
    spark: SparkSession, spec: TableSpec, seed: int | str = 42, n: int | None = None, reference: DataFrame | None = None,
    reference_key: str | None = None, quasi_identifiers: list[str] | None = None, noise_level: float = 0.01,
    attackers: int = 1000, target: str | None = None, anomalies: dict | None = None, tolerance: dict | None = None,
    texts: DataFrame | None = None, text: str = "text", text_key: str = "page_id", hints: dict | None = None,
    search_rounds: int = 0, objective: str = "balanced", learner: str = "boosted", **generation,
) -> dict[str, DataFrame]:
    """Report tables by name. The generated table is written once to the shared folder and reused.

    ``texts`` enrich the specification before anything is generated.
    """
    mined = None
    if texts is not None:
        spec, mined = enrich(spec, texts, text, text_key, hints)
    if search_rounds and reference is not None:
        spec, history = sweep.search(spec, reference, rounds=search_rounds, key=reference_key, identifiers=quasi_identifiers, target=target,
                                     objective=objective if reference_key else None)
    made = generate_table(spark, spec, seed, n, reference, **generation)
    if anomalies:
        made = tables.inject_anomalies(made, spec, anomalies.get("type", "large_exfil"), int(anomalies.get("n", 0)), seed)
    table = materialize(made, "generated")
    plain = table.drop(ID, "_is_anomaly")
    numeric = [c for c in spec.names("int", "float")]
    cats = spec.names("category")
    out = {
        "table": table,
        "findings": validate.validate_table(plain, spec, tolerance=tolerance or {"class_balance": 0.01}),
        "field_stats": profile.field_stats_validated(plain, spec),
        "quick_score": profile.realism_quick_score(plain, spec),
        "fingerprint": table_fingerprint(plain, spec, seed),
    }
    if mined is not None:
        out["mined"] = mined
    if search_rounds and reference is not None:
        out["search_history"] = history
    if numeric:
        out["histograms"] = profile.histogram(plain, numeric)
        out["correlation"] = profile.corr_heatmap_table(plain, numeric)
    if cats:
        out["bars"] = profile.bar_counts(plain, cats)
    if "role" in spec.names() and "salary" in spec.names():
        out["role_salary"] = profile.density_grid(plain, "role", "salary")
    flags = spec.names("bool")
    if flags:
        if numeric:
            out["explain_numeric"] = utility.explain_numeric(plain, flags[0], numeric)
        if cats:
            out["explain_lift"] = utility.explain_lift(plain, flags[0], cats)
    if reference is not None:
        shared = set(reference.columns)
        num, cat = [c for c in numeric if c in shared], [c for c in cats if c in shared]
        out["realism"] = realism.realism_composite(plain, reference, num, cat)
        out["feature_ranking"] = realism.feature_ranking(plain, reference, num, cat)
        qi = quasi_identifiers or num + cat
        if reference_key and qi:
            ids = table.where(f"{ID} is not null")
            synthetic = ids.withColumnRenamed(ID, reference_key) if reference_key not in table.columns else ids
            out["privacy"] = privacy.reid_risk(synthetic, reference, qi, reference_key, attackers, noise_level)
            if target:
                out["utility"] = utility.train_synth_test_real(synthetic.select(reference_key, *num, *cat, *([target] if target not in num + cat else [])),
                                                               reference, target, reference_key, learner=learner)
    return out


def reproduce(spark: SparkSession, spec: TableSpec, seed: int | str, table: DataFrame, n: int | None = None) -> DataFrame:
    """Generate again and compare with a stored table on its row id."""
    return tables.compare_tables(table, generate(spark, spec, seed, n), ID)
