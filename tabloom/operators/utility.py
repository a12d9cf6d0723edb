"""Does synthetic data train a model that works on real data, and what explains a label?"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.rng import uniform
from tabloom.operators import boosting
from tabloom.operators.coerce import drop_null_target, number, numeric_columns
from tabloom.operators.profile import rank_correlation, value_counts, with_ranks
from tabloom.operators.realism import topk_shares


def onehot_top(df: DataFrame, columns: list[str], k: int = 20, fitted: dict | None = None) -> tuple[DataFrame, dict]:
    """Indicator columns for the k most frequent values; ``fitted`` reuses the values of another table.

    At most k values per column reach the driver.
    """
    if fitted is None:
        rows = topk_shares(df, columns, k).orderBy("field", F.desc("n"), "value").collect() if columns else []
        fitted = {c: [r["value"] for r in rows if r["field"] == c] for c in columns}
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("__null__")) for c in columns}
    marks = {f"{c}__{i}": (text[c] == F.lit(v)).cast("double") for c in columns for i, v in enumerate(fitted[c])}
    return df.withColumns(marks) if marks else df, fitted


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed=0) -> DataFrame:
    """Add ``is_test``; the smallest draw is always in the test part, so it is never empty."""
    drawn = df.withColumn("_u", uniform(seed, "split", key))
    least = df.agg(F.min(uniform(seed, "split", key)).alias("m"))
    test = (F.col("_u") < F.lit(float(test_share))) | (F.col("_u") == least.select("m").scalar())
    return drawn.withColumn("is_test", test.cast("int")).drop("_u")


def is_classification(df: DataFrame, target: str, max_classes: int = 20) -> bool:
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return True
    if isinstance(kind, T.IntegralType):
        return df.select(target).distinct().limit(max_classes + 1).count() <= max_classes
    return False


def confusion_matrix(scored: DataFrame, truth: str = "y", predicted: str = "prediction") -> DataFrame:
    return scored.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def shared_features(synthetic: DataFrame, reference: DataFrame, target: str, skip: tuple = ()) -> tuple[list[str], list[str]]:
    """(numeric, text) columns that both tables have."""
    features = [c for c in synthetic.columns if c in reference.columns and c not in (target, *skip)]
    numeric = numeric_columns(synthetic, features)
    numeric = [c for c in features if c in numeric]
    return numeric, [c for c in features if c not in numeric and isinstance(synthetic.schema[c].dataType, (T.StringType, T.BooleanType))]


def is_task(synthetic: DataFrame, target: str, task: str | None) -> bool:
    """Whether classes are to be told apart; ``task`` says so, or the target's type and number of values."""
    if task not in (None, "classification", "regression"):
        raise ValueError(f"unknown task {task}")
    return is_classification(synthetic, target) if task is None else task == "classification"


def forest_predictions(synthetic: DataFrame, reference: DataFrame, target: str, key: str, seed: int, trees: int, test_share: float, task: str | None):
    s, r = drop_null_target(synthetic, target), hash_split(drop_null_target(reference, target), key, test_share, seed)
    numeric, text = shared_features(s, r, target, (key,))
    classify = is_task(s, target, task)
    train, fitted = onehot_top(s, text)
    score, _ = onehot_top(r, text, fitted=fitted)
    marks = [f"{c}__{i}" for c in text for i in range(len(fitted[c]))]

    def as_double(df):
        return df.withColumns({c: F.col(c).cast("double") for c in numeric})

    train, score = as_double(train), as_double(score)
    if classify:
        # At most 20 numeric classes or the values of a text label; the codes are fixed by the training data.
        seen = value_counts(train, [target]).select("value").orderBy("value").collect()
        codes = {row["value"]: float(i) for i, row in enumerate(seen)}
        pairs = [x for v, i in codes.items() for x in (F.lit(v), F.lit(i))]
        code = F.try_element_at(F.create_map(*pairs), F.col(target).cast("string"))
        train, score = train.withColumn("y", code), score.withColumn("y", F.coalesce(code, F.lit(-1.0)))
        learner = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, seed=seed)
    else:
        train, score = train.withColumn("y", F.col(target).cast("double")), score.withColumn("y", F.col(target).cast("double"))
        learner = RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=trees, seed=seed)
    stages = [Imputer(strategy="mean", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric])] if numeric else []
    stages += [VectorAssembler(inputCols=[f"{c}__i" for c in numeric] + marks, outputCol="features"), learner]
    model = Pipeline(stages=stages).fit(train)
    return model.transform(score).select(key, "y", "prediction", "is_test"), classify


def boosted_predictions(synthetic: DataFrame, reference: DataFrame, target: str, key: str, seed: int = 0, test_share: float = 0.2,
                        task: str | None = None, settings: boosting.Settings | None = None, group: str | None = None, groups: int = 1,
                        group_key: str | None = None, held_out: bool = False):
    """(reference rows with key, is_test, group, y and prediction; is_classification): boosted trees fitted on synthetic rows.

    ``group`` numbers synthetic tables that lie in one, 0 to ``groups`` - 1; each gets its own models, all fitted in one job, and
    every reference row (of the held-out part alone with ``held_out``) is scored by all of them. Classes are coded by their place in ascending order of text, others as -1.
    """
    tag, row = group or "_group", group_key or key
    s = drop_null_target(synthetic, target)
    s = s if group else s.withColumn(tag, F.lit(0))
    r = hash_split(drop_null_target(reference, target), key, test_share, seed)
    r = r.where("is_test = 1") if held_out else r
    numeric, text = shared_features(s, r, target, (key, row, tag))
    classify = is_task(s, target, task)
    train, fitted = onehot_top(s, text)
    score, _ = onehot_top(r, text, fitted=fitted)
    features = numeric + [f"{c}__{i}" for c in text for i in range(len(fitted[c]))]
    classes = boosting.classes_of(train, target, tag) if classify else None
    models = boosting.fit(train, features, target, tag, row, classes, settings or boosting.Settings(seed=seed)) if classes or not classify else []
    # The target goes along under a name that the marks cannot have.
    scored = boosting.predict(score.withColumn("y", F.col(target).cast("string" if classify else "double")), features, models, groups, classes or ([""] if classify else None),
                              [key, "is_test", "y"])
    flat = scored.select(key, "is_test", "y", F.posexplode("predicted").alias(tag, "prediction"))
    if classify:
        code = {c: (F.array_position(F.array(*[F.lit(v) for v in classes or [""]]), F.col(c)) - 1).cast("double") for c in ("y", "prediction")}
        flat = flat.withColumns({c: F.coalesce(x, F.lit(-1.0 if c == "y" else -2.0)) for c, x in code.items()})
    return flat, classify


LEARNERS = ("boosted", "forest")


def predictions(synthetic: DataFrame, reference: DataFrame, target: str, key: str, seed: int = 0, trees: int = 50, test_share: float = 0.2,
                task: str | None = None, learner: str = "forest"):
    """(scored reference rows with ``is_test``, is_classification): fit on synthetic, score on real.

    Encoders are fitted once, on the training table. ``task`` is "classification" or "regression"; without it the
    target's type and number of distinct values decide (``is_classification``). ``learner`` is "boosted" (depth 4, four fifths of rows
    and features per tree) or "forest".
    """
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner}")
    if learner == "forest":
        return forest_predictions(synthetic, reference, target, key, seed, trees, test_share, task)
    rows, classify = boosted_predictions(synthetic, reference, target, key, seed, test_share, task, boosting.Settings(rounds=trees, seed=seed))
    return rows.select(key, "y", "prediction", "is_test"), classify


def utility_scores(scored: DataFrame, classify: bool, by: list[str]) -> DataFrame:
    """Accuracy for classes; R2 on the training part and minus RMSE on the held-out part for numbers; per value of ``by``."""
    train, test = F.col("is_test") == 0, F.col("is_test") == 1
    if classify:
        hit = (F.col("y") == F.col("prediction")).cast("double")
        scores = [F.avg(F.when(train, hit)).alias("synthetic_train_score"), F.avg(F.when(test, hit)).alias("real_test_score")]
    else:
        error, known = (F.col("y") - F.col("prediction")) ** 2, F.when(train, F.col("y"))
        unexplained = F.try_divide(F.avg(F.when(train, error)), F.var_pop(known))
        scores = [(F.lit(1.0) - unexplained).alias("synthetic_train_score"), (-F.sqrt(F.avg(F.when(test, error)))).alias("real_test_score")]
    return scored.groupBy(*by).agg(*scores)


def train_synth_test_real(synthetic: DataFrame, reference: DataFrame, target: str, key: str, seed: int = 0, trees: int = 50,
                          task: str | None = None, learner: str = "forest") -> DataFrame:
    """One row: score on the real training part, score on the held-out part, their difference.

    Accuracy for classes; R2 on the training part and minus RMSE on the held-out part for numbers.
    """
    scored, classify = predictions(synthetic, reference, target, key, seed, trees, task=task, learner=learner)
    return utility_scores(scored, classify, []).select(
        "synthetic_train_score", "real_test_score",
        (F.col("real_test_score") - F.col("synthetic_train_score")).alias("delta"),
        F.lit(int(classify)).alias("is_classification"))


def candidate_utility(samples: DataFrame, reference: DataFrame, target: str, key: str, sample_key: str, candidate: str = "candidate",
                      candidates: int = 1, seed: int = 0, task: str | None = None) -> DataFrame:
    """(candidate, real_test_score, is_classification) of all candidates' tables: their models are fitted in one job."""
    scored, classify = boosted_predictions(samples, reference, target, key, seed, task=task, group=candidate, groups=candidates, group_key=sample_key, held_out=True)
    return utility_scores(scored, classify, [candidate]).select(candidate, "real_test_score", F.lit(int(classify)).alias("is_classification"))


# ---- explanation ------------------------------------------------------------------------------


def label_as_int(df: DataFrame, label: str):
    return F.coalesce(number(df, label), F.lit(0.0)).cast("int")


def explain_numeric(df: DataFrame, label: str, columns: list[str], top: int = 3) -> DataFrame:
    """(field, rho): rank correlation with the label, strongest first; constant columns are skipped."""
    filled = df.select(label_as_int(df, label).alias("_y"), *[F.coalesce(number(df, c), F.lit(0.0)).alias(c) for c in columns])
    ranked, n = with_ranks(filled, ["_y", *columns])
    spread = [(F.min(c) != F.max(c)).alias(f"{c}|v") for c in columns]
    one = rank_correlation(ranked, n, [(c, "_y") for c in columns], list(columns), *spread)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("rho"), F.col(f"`{c}|v`").alias("varies")) for c in columns])
    rows = one.select(F.explode(cells).alias("c")).select("c.*").where(F.col("varies") & F.col("rho").isNotNull())
    return rows.select("field", "rho").orderBy(F.desc(F.abs("rho")), "field").limit(top)


def explain_lift(df: DataFrame, label: str, columns: list[str], top: int = 3) -> DataFrame:
    """(field, value, lift): P(label | value) / P(label), largest first."""
    y = label_as_int(df, label)
    base = df.agg(F.avg(y).alias("p")).select("p").scalar()
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    g = df.select(y.alias("_y"), F.explode(cells).alias("c")).select("_y", "c.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.avg("_y").alias("p"))
    lift = F.when(base > 0, F.col("p") / base).otherwise(F.lit(0.0))
    return g.select("field", "value", lift.alias("lift")).orderBy(F.desc("lift"), "field", "value").limit(top)


def objective_score(rows: DataFrame, objective: str = "balanced") -> DataFrame:
    """Add utility_score, risk_score and objective to rows of (realism, real_test_score, is_classification, reid_rate)."""
    def bounded(x):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))

    utility = F.when(F.col("is_classification") == 1, bounded(F.lit(100.0) * F.col("real_test_score"))).otherwise(
        bounded(F.lit(100.0) * (F.lit(1.0) + F.col("real_test_score") / F.lit(10.0))))
    scored = rows.withColumn("utility_score", utility).withColumn("risk_score", bounded(F.lit(100.0) * F.col("reid_rate")))
    # Weights of the balanced objective.
    value = {
        "realism": F.col("realism"),
        "utility": F.col("utility_score"),
        "privacy": F.lit(100.0) - F.col("risk_score"),
        "test_score": F.col("real_test_score"),
        "balanced": F.lit(0.45) * F.col("realism") + F.lit(0.35) * F.col("utility_score") - F.lit(0.20) * F.col("risk_score"),
    }[objective]
    return scored.withColumn("objective", value)
