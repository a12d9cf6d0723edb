"""Gradient boosted trees for many tables at once: one task fits one table's (or one class's) model.

Every group of a table (a search candidate, say) gets its own models, all in one job: its rows, or a hash sample of at most about
``FIT_ROWS`` of them, meet in one task per class, where trees are grown stage by stage over binned features. The models are
rows of a table themselves, small enough to be broadcast, and any number of rows is scored where it lies.

More than two classes are told apart one against the rest; the highest score wins, then the earlier class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.rng import uniform

#: Rows of a group that a model is fitted on at most, about.
FIT_ROWS = 20_000
#: Values of a text or integer target that are told apart: the most frequent ones.
MOST_CLASSES = 20
BINS = 32


@dataclass(frozen=True)
class Settings:
    """Stages, depth, learning rate, shares of rows and of features per tree, and the penalty on leaf weights."""

    rounds: int = 50
    depth: int = 4
    rate: float = 0.3
    rows: float = 0.8
    features: float = 0.8
    penalty: float = 1.0
    seed: int = 0


MODEL = "group int, class int, means array<double>, base double, trees int, depth int, splits array<int>, limits array<double>, leaves array<double>"


def grow(binned: np.ndarray, slope: np.ndarray, weight: np.ndarray, columns: np.ndarray, s: Settings):
    """One tree as arrays over a full binary tree: feature and last bin to the left of every inner node (-1: all left), leaf weights."""
    n, inner = len(binned), (1 << s.depth) - 1
    split, cut, node = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(n, np.int64)
    for level in range(s.depth):
        width, first = 1 << level, (1 << level) - 1
        gain, best = np.full(width, 1e-9), [(-1, 0)] * width
        for f in columns:
            at = node * BINS + binned[:, f]
            g = np.bincount(at, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
            h = np.bincount(at, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
            total_g, total_h = g[:, -1:], h[:, -1:]
            value = g**2 / (h + s.penalty) + (total_g - g) ** 2 / (total_h - h + s.penalty) - total_g**2 / (total_h + s.penalty)
            value[:, -1] = 0.0
            k = value.argmax(axis=1)
            better = value[np.arange(width), k] > gain
            gain[better] = value[better, k[better]]
            for i in np.flatnonzero(better):
                best[i] = (f, int(k[i]))
        split[first:first + width], cut[first:first + width] = zip(*best)
        f = split[first + node]
        right = (f >= 0) & (binned[np.arange(n), np.maximum(f, 0)] > cut[first + node])
        node = 2 * node + right
    leaves = -s.rate * np.bincount(node, slope, 1 << s.depth) / (np.bincount(node, weight, 1 << s.depth) + s.penalty)
    return split, cut, leaves, node


def boost(x: np.ndarray, y: np.ndarray, logistic: bool, s: Settings, number: int) -> dict:
    """A model of y (0 or 1 if ``logistic``) from x, whose missing cells are read as the column's mean."""
    known = np.isfinite(x)
    means = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    x = np.where(known, x, means)
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if x.shape[1] else np.zeros((len(x), 0), np.int64)
    draw = np.random.default_rng([s.seed, number])
    base = float(y.mean())
    base = float(np.log((base + 1e-9) / (1 - base + 1e-9))) if logistic else base
    score = np.full(len(y), base)
    splits, limits, leaves = [], [], []
    for _ in range(s.rounds if x.shape[1] else 0):
        used = draw.random(len(y)) < s.rows
        columns = np.sort(draw.permutation(x.shape[1])[:max(1, round(s.features * x.shape[1]))])
        p = 1 / (1 + np.exp(-score)) if logistic else score
        slope, weight = (p - y) * used, (p * (1 - p) if logistic else np.ones(len(y))) * used
        split, cut, leaf, node = grow(binned, slope, weight, columns, s)
        score = score + leaf[node]
        splits.append(split)
        limits.append([edges[f][min(c, len(edges[f]) - 1)] if f >= 0 and len(edges[f]) else np.inf for f, c in zip(split, cut)])
        leaves.append(leaf)
    return {"means": means, "base": base, "trees": len(splits), "depth": s.depth,
            **{k: np.concatenate(v).tolist() if v else [] for k, v in (("splits", splits), ("limits", limits), ("leaves", leaves))}}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    """The model's scores; every tree is walked for all rows at once."""
    x = np.where(np.isfinite(x), x, np.asarray(model["means"], float))
    out, inner = np.full(len(x), model["base"]), (1 << model["depth"]) - 1
    flat, rows = x.ravel(), np.arange(len(x)) * x.shape[1]
    splits, limits, leaves = (np.asarray(model[c]).reshape(model["trees"], inner + more) for c, more in (("splits", 0), ("limits", 0), ("leaves", 1)))
    for split, limit, leaf in zip(np.maximum(splits, 0).astype(np.int64), np.where(splits >= 0, limits, np.inf), leaves):  # no split: all left
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (flat.take(rows + split.take(node)) > limit.take(node))
        out += leaf.take(node - inner)
    return out


def classes_of(train: DataFrame, label: str, group: str) -> list[str]:
    """The most frequent values of the label over all groups, in ascending order."""
    counts = train.groupBy(F.col(label).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v IS NOT NULL")
    return sorted(r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(MOST_CLASSES).collect())


def fit(train: DataFrame, features: list[str], label: str, group: str, key: str, classes: list[str] | None, settings: Settings = Settings(),
        fit_rows: int = FIT_ROWS) -> list[dict]:
    """One model per group (and class, if there are more than two) of ``train``; ``classes`` None means a numeric label.

    What comes to the driver are the models: some 50 trees of 31 numbers for each.
    """
    sizes = train.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    some = train.join(F.broadcast(sizes), group).where(uniform(settings.seed, "fit", group, key) < F.lit(float(fit_rows)) / F.col("_size"))
    numbers = list(range(len(classes))) if classes and len(classes) > 2 else [len(classes) - 1] if classes else [0]
    value = F.col(label).cast("string" if classes else "double")
    rows = some.select(F.col(group).cast("int").alias("group"), F.explode(F.array(*[F.lit(i) for i in numbers])).alias("class"), F.col(key).alias("_key"),
                       value.alias("label"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")).where("label IS NOT NULL")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        number = int(pdf["class"].iloc[0])
        y = (pdf["label"] == classes[number]).to_numpy(float) if classes else pdf["label"].to_numpy(float)
        made = boost(np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), y, classes is not None, settings, number)
        return pd.DataFrame([{"group": int(pdf["group"].iloc[0]), "class": number, **made}])

    return [r.asDict() for r in rows.groupBy("group", "class").applyInPandas(one, MODEL).collect()]


def predict(rows: DataFrame, features: list[str], models: list[dict], groups: int, classes: list[str] | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``predicted``: for every group its prediction, a class's text or a number (null without a model)."""
    shared = rows.sparkSession.sparkContext.broadcast(sorted(models, key=lambda m: (m["group"], m["class"])))
    kind = T.ArrayType(T.StringType() if classes else T.DoubleType())
    slim = rows.select(*keep, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), -1)
            out = np.full((len(pdf), groups), None, object)
            for g in range(groups):
                mine = [m for m in shared.value if m["group"] == g]
                scores = [apply(m, x) for m in mine]
                if not mine:
                    continue
                if not classes:
                    out[:, g] = scores[0]
                elif len(mine) == 1:
                    other = classes[0]
                    out[:, g] = np.where(scores[0] > 0, classes[mine[0]["class"]], other)
                else:
                    out[:, g] = np.array([classes[m["class"]] for m in mine], object)[np.argmax(scores, axis=0)]
            yield pdf[keep].assign(predicted=list(out.tolist()))

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("predicted", kind)])
    return slim.mapInPandas(run, schema)
