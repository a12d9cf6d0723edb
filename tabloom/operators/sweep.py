"""Search over specification parameters: a batch of candidates per round, scored together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.functions.rng import uniform
from tabloom.operators import privacy, realism, utility
from tabloom.operators.generate import ID, generate
from tabloom.sources.runtime import materialize
from tabloom.spec import TableSpec

OBJECTIVES = ("balanced", "realism", "utility", "privacy", "test_score")
PARAMETERS = "field string, param string, idx int, value double"


def parameter_rows(spec: TableSpec, bounds: bool = False) -> list[tuple]:
    """The searchable numbers of a specification: mean, std (min, max) and probabilities."""
    rows = []
    for f in spec.fields:
        if f.numeric:
            names = ("mean", "std", "min", "max") if bounds else ("mean", "std")
            rows += [(f.name, p, 0, float(getattr(f, p))) for p in names if getattr(f, p) is not None]
        elif f.type == "category" and f.categories and f.probs:
            rows += [(f.name, "probs", i, float(q)) for i, q in enumerate(f.probs)]
    return rows


def perturb_specs(base: DataFrame, candidates: int, alpha: float = 0.10, seed=0, include_base: bool = True) -> DataFrame:
    """(candidate, field, param, idx, value) from rows (field, param, idx, value).

    Candidate 0 is the unchanged specification. Numbers move by a factor 1 +- alpha; probabilities move
    by +- alpha, are cut at 1e-12 and normalised again.
    """
    first = 0 if include_base else 1
    many = base.withColumn("candidate", F.explode(F.sequence(F.lit(first), F.lit(candidates))))
    shift = F.lit(2.0 * alpha) * uniform(seed, "perturb", "candidate", "field", "param", "idx") - F.lit(float(alpha))
    moved = F.when(F.col("param") == "probs", F.greatest(F.lit(1e-12), F.col("value") + shift)).otherwise(F.col("value") * (F.lit(1.0) + shift))
    moved = F.when(F.col("param") == "std", F.greatest(F.lit(1e-9), moved)).otherwise(moved)
    out = many.withColumn("value", F.when(F.col("candidate") == 0, F.col("value")).otherwise(moved))
    total = F.sum("value").over(Window.partitionBy("candidate", "field", "param"))
    return out.select("candidate", "field", "param", "idx",
                      F.when(F.col("param") == "probs", F.col("value") / total).otherwise(F.col("value")).alias("value"))


def apply_parameters(spec: TableSpec, rows: list) -> TableSpec:
    changes: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        mine = changes.setdefault(r["field"], {})
        if r["param"] == "probs":
            mine["probs"] = (*mine.get("probs", ()), r["value"])
        else:
            mine[r["param"]] = r["value"]
    for mine in changes.values():
        if None not in (mine.get("min"), mine.get("max")) and mine["min"] > mine["max"]:
            mine["min"], mine["max"] = mine["max"], mine["min"]
    return spec.with_fields(**changes)


def candidate_tables(spark: SparkSession, specs: list[TableSpec], budget: int, seed=42) -> DataFrame:
    """All candidates' rows in one table, told apart by ``candidate``."""
    parts = [generate(spark, s, seed, budget, repair=False).withColumn("candidate", F.lit(i)) for i, s in enumerate(specs)]
    return reduce(DataFrame.unionByName, parts)


def candidate_scores(samples: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str], candidates: int,
                     facts: dict | None = None) -> DataFrame:
    """(candidate, numeric_score, categorical_score, composite_score) for all candidates in one job.

    The reference is aggregated once, or read from its ``facts`` (``realism.reference_facts``); the candidates are weight columns
    or a grouping key beside it. Rows of different tables have no common key, so the rank term is left out.
    """
    parts = []
    if numeric:
        ks = realism.ks_and_emd_many(samples, reference, numeric, candidates, "candidate", facts)
        std = facts["moments"] if facts else realism.side_moments(reference, reference, numeric).select("field", "std_ref")
        decay = F.exp(-F.col("emd") / ((F.col("std_ref") + F.lit(1e-9)) * F.lit(3.0)))
        a, b = realism.NUM_SCORE[0], realism.NUM_SCORE[1]
        parts.append(ks.join(F.broadcast(std), "field").select(
            "candidate", F.lit("numeric").alias("kind"), ((a * (1 - F.col("ks_stat")) + b * decay) / F.lit(a + b)).alias("score")))
    if categorical:
        g = realism.topk_shares(samples, categorical, keep=["candidate"]).select("candidate", "field", "value", F.col("share").alias("p"))
        r = (facts["shares"] if facts else realism.topk_shares(reference, categorical)).select("field", "value", F.col("share").alias("q"))
        r = r.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
        by = ["candidate", "field"]
        pairs = g.join(r, [*by, "value"], "full_outer").select(*by, "value", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
        parts.append(realism.pair_statistics(pairs, by).select("candidate", F.lit("categorical").alias("kind"), realism.category_score().alias("score")))
    return realism.composite(reduce(DataFrame.unionByName, parts), ["candidate"])


def select_best(scores: DataFrame, score: str = "objective") -> DataFrame:
    """The best candidate; an equal score never replaces an earlier candidate."""
    return scores.groupBy().agg(
        F.max_by(F.struct("candidate", score), F.struct(F.col(score), -F.col("candidate"))).alias("b")).select("b.*")


HISTORY = "round int, candidate int, objective double, realism double, utility double, privacy_risk double"


class Objective:
    """How good candidates' tables are: realism, utility of models and re-identification risk, each for all candidates at once.

    Without a ``target`` the utility is the neutral 50. Without a ``key`` of the reference (its rows cannot be split or drawn) only the
    realism is known, and only the objective "realism" can be asked for. ``name`` is "balanced", "realism", "utility", "privacy" or
    "test_score" (the bare held-out score of the models).
    """

    def __init__(self, spec: TableSpec, reference: DataFrame, name: str | None = None, target: str | None = None, key: str | None = None,
                 identifiers: list[str] | None = None, attackers: int = 1000, seed=0):
        self.numeric = [c for c in spec.names("int", "float") if c in reference.columns and c != key]
        self.categorical = [c for c in spec.names("category") if c in reference.columns and c != key]
        self.name, self.target, self.key = name or ("balanced" if key else "realism"), target, key
        if self.name not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.name}")
        if key is None and self.name != "realism":
            raise ValueError(f"the objective {self.name} needs the reference's key")
        if self.name == "test_score" and target is None:
            raise ValueError("the objective test_score needs a target")
        if target is not None and target not in reference.columns:
            raise ValueError(f"the reference has no column {target}")
        self.reference, self.seed = reference, seed
        self.columns = list(dict.fromkeys([*self.numeric, *self.categorical, *([target] if target else [])]))
        self.reference_facts = realism.reference_facts(reference, self.numeric, self.categorical)
        known = identifiers or self.numeric + self.categorical
        self.facts = privacy.risk_facts(reference, known, key, ID, attackers, seed) if key else None
        if self.facts:
            self.columns = list(dict.fromkeys([*self.columns, *self.facts["numeric"], *self.facts["categorical"]]))

    def measured(self, samples: DataFrame, candidates: int) -> DataFrame:
        """(candidate, realism, real_test_score, is_classification, reid_rate) of ``samples`` (candidate, _id and the columns)."""
        rows = candidate_scores(samples, self.reference, self.numeric, self.categorical, candidates, self.reference_facts).select(
            "candidate", F.col("composite_score").alias("realism"))
        if not self.key:
            return rows
        rows = rows.join(privacy.candidate_risk(samples, self.facts, "candidate", candidates), "candidate")
        if not self.target:
            return rows.withColumns({"real_test_score": F.lit(0.5), "is_classification": F.lit(1)})
        mine = [c for c in self.columns if c != self.key]
        learned = utility.candidate_utility(samples.select("candidate", ID, *mine), self.reference.select(self.key, *mine), self.target, self.key, ID,
                                            "candidate", candidates, self.seed if isinstance(self.seed, int) else 0)
        return rows.join(learned, "candidate")

    def scores(self, samples: DataFrame, candidates: int) -> DataFrame:
        """(candidate, objective, realism, utility, privacy_risk)."""
        rows = self.measured(samples, candidates)
        if not self.key:
            none = F.lit(None).cast("double")
            return rows.select("candidate", F.col("realism").alias("objective"), "realism", none.alias("utility"), none.alias("privacy_risk"))
        return utility.objective_score(rows, self.name).select(
            "candidate", "objective", "realism", F.col("utility_score").alias("utility"), F.col("risk_score").alias("privacy_risk"))


def search(
    spec: TableSpec, reference: DataFrame, rounds: int = 2, batch: int = 4, budget: int = 2000, alpha: float = 0.10, seed=0,
    objective: str | None = None, target: str | None = None, key: str | None = None, identifiers: list[str] | None = None, bounds: bool = False,
) -> tuple[TableSpec, DataFrame]:
    """(best specification, history of (round, candidate, objective, realism, utility, privacy_risk)).

    Each round generates and scores a batch around the best specification so far; candidate 0 is that specification itself, so a
    round never makes it worse. A round is a handful of jobs whatever the batch: all candidates lie in one table, are measured against
    the reference together, searched for attackers in one scan, and their models are fitted side by side. Attackers and
    threshold are found once. Only scores, models and parameters reach the driver. ``bounds`` moves minimum and maximum as well.
    """
    spark = reference.sparkSession
    attackers = min(budget, reference.count()) if key else 0
    goal = Objective(spec, reference, objective, target, key, identifiers, attackers, seed)
    best, history = spec, []
    for step in range(rounds):
        base = spark.createDataFrame(parameter_rows(best, bounds), PARAMETERS)
        table = perturb_specs(base, batch, alpha, f"{seed}/{step}").collect()
        specs = [apply_parameters(best, [r for r in table if r["candidate"] == i]) for i in range(batch + 1)]
        made = candidate_tables(spark, specs, budget, seed)
        samples = materialize(made.select("candidate", ID, *[c for c in goal.columns if c in made.columns]), "samples")
        rows = goal.scores(samples, batch + 1).collect()
        history += [(step, *(None if v is None else v if isinstance(v, int) else float(v) for v in r)) for r in rows]
        winner = max(rows, key=lambda r: (r["objective"], -r["candidate"]))["candidate"]
        best = specs[winner]
    return best, spark.createDataFrame(history, HISTORY)


def advice(history: DataFrame) -> DataFrame:
    """One row: first and best objective of a search, and whether its best specification is worth taking over."""
    first = F.min_by("objective", F.struct("round", "candidate"))
    better = F.max("objective") > first
    return history.agg(first.alias("first"), F.max("objective").alias("best"),
                       F.when(better, F.lit("take the best specification over")).otherwise(F.lit("no better specification within this budget")).alias("advice"))
