"""Boosted trees, the attackers' tree and the search by all its objectives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import boosting, privacy, sweep, utility
from tabloom.operators.generate import generate
from tabloom.spec import TableSpec

# ---- boosted trees ----------------------------------------------------------------------------


def test_boost_learns_steps_and_applies_what_it_learned():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 4))
    y = 3.0 * (x[:, 0] > 0.3) - 2.0 * (x[:, 2] > -0.5)
    s = boosting.Settings()
    model = boosting.boost(x, y, False, s, 0)
    assert model["trees"] == 50 and np.sqrt(np.mean((boosting.apply(model, x) - y) ** 2)) < 0.25
    fewer = boosting.boost(x, y, False, boosting.Settings(rounds=3), 0)
    assert np.mean((boosting.apply(fewer, x) - y) ** 2) > np.mean((boosting.apply(model, x) - y) ** 2)


def test_boost_agrees_with_growing():
    """Walking the tree gives every training row the leaf it was grown into."""
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 9, size=(500, 3)).astype(float)
    x[::17, 1] = np.nan
    y = (np.nan_to_num(x[:, 1], nan=4.0) > x[:, 0]).astype(float)
    for depth in (1, 2, 4):
        s = boosting.Settings(rounds=1, depth=depth, rows=1.0, features=1.0)
        model = boosting.boost(x, y, True, s, 0)
        filled = np.where(np.isfinite(x), x, model["means"])
        edges = [np.unique(np.quantile(c, np.arange(1, boosting.BINS) / boosting.BINS)) for c in filled.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, filled.T)], axis=1)
        p = 1 / (1 + np.exp(-model["base"]))
        _, _, leaves, node = boosting.grow(binned, p - y, np.full(len(y), p * (1 - p)), np.arange(3), s)
        assert np.allclose(boosting.apply(model, x), model["base"] + leaves[node])


@pytest.mark.parametrize("x, y", [(np.zeros((5, 2)), np.ones(5)), (np.zeros((1, 1)), np.zeros(1)), (np.full((4, 1), np.nan), np.array([0.0, 1, 0, 1])), (np.zeros((3, 0)), np.ones(3))])
def test_boost_of_little(x, y):
    for logistic in (False, True):
        out = boosting.apply(boosting.boost(x, y, logistic, boosting.Settings(rounds=4), 0), x)
        assert len(out) == len(y) and np.isfinite(out).all()


SPEC = TableSpec.from_dict({"fields": [{"name": "width", "type": "float"}, {"name": "height", "type": "float"},
                                       {"name": "shade", "type": "category", "categories": ["dark", "mid", "pale"]}]})


@pytest.fixture(scope="module")
def shapes(spark):
    rows = generate(spark, SPEC, 1, 900)
    kind = F.when(F.col("width") < 30, "slim").when(F.col("shade") == "dark", "heavy").otherwise("plain")
    return rows.withColumn("kind", kind).withColumn("wide", (F.col("width") + F.col("height") > 100).cast("int")).withColumn("area", F.col("width") * F.col("height"))


@pytest.mark.parametrize("learner", utility.LEARNERS)
def test_learners_tell_classes_apart(spark, shapes, learner):
    syn = privacy.laplace_noise(shapes, ["width", "height"], 0.01, "_id")
    for target, drop in (("wide", ["kind", "area"]), ("kind", ["wide", "area"])):
        row = utility.train_synth_test_real(syn.drop(*drop), shapes.drop(*drop), target, "_id", trees=25, learner=learner).first()
        assert row.is_classification == 1 and row.real_test_score > 0.88, target
        assert row.delta == pytest.approx(row.real_test_score - row.synthetic_train_score)


def test_boosted_numbers_and_odd_targets(spark, shapes):
    near = utility.train_synth_test_real(shapes.drop("kind", "wide"), shapes, "area", "_id", learner="boosted").first()
    assert near.is_classification == 0 and near.synthetic_train_score > 0.9 and -600 < near.real_test_score < 0
    holes = shapes.withColumn("kind", F.when(F.col("_id") % 3 > 0, F.col("kind"))).withColumn("width", F.when(F.col("_id") % 5 > 0, F.col("width")))
    scored, classify = utility.predictions(holes.drop("wide", "area"), holes, "kind", "_id", trees=10, learner="boosted")
    assert classify and scored.count() == 600
    # A class that the synthetic table lacks counts as wrong, never as missing.
    other = shapes.withColumn("kind", F.when(F.col("kind") == "slim", "unheard").otherwise(F.col("kind")))
    scored, _ = utility.predictions(shapes, other, "kind", "_id", trees=5, learner="boosted")
    assert {r.y for r in scored.where("y < 0").collect()} == {-1.0} and scored.count() == 900
    with pytest.raises(ValueError):
        utility.predictions(shapes, shapes, "kind", "_id", learner="guess")


def test_every_group_has_its_own_model(spark, shapes):
    """Two tables in one, with opposite labels: each group's model says its own."""
    a = shapes.select("_id", "width", "height", "wide").withColumn("g", F.lit(0))
    both = a.unionByName(a.withColumn("wide", 1 - F.col("wide")).withColumn("g", F.lit(1)))
    scores = {r.g: r.real_test_score for r in utility.candidate_utility(both, a.drop("g").withColumnRenamed("_id", "key"), "wide", "key", "_id", "g", 3).collect()}
    assert scores[0] > 0.9 and scores[1] < 0.1 and scores[2] == 0.0  # the third has no rows and so no model


def test_fit_takes_a_bounded_sample(spark, shapes):
    rows = shapes.select("_id", "width", "height", "wide").withColumn("g", F.lit(0))
    few = boosting.fit(rows, ["width", "height"], "wide", "g", "_id", ["0", "1"], boosting.Settings(rounds=2), fit_rows=90)
    again = boosting.fit(rows.repartition(5), ["width", "height"], "wide", "g", "_id", ["0", "1"], boosting.Settings(rounds=2), fit_rows=90)
    assert len(few) == 1 and few == again


# ---- nearest rows -----------------------------------------------------------------------------


def brute_nearest(points, pools, k):
    out = {}
    for v, rows in pools.items():
        for d, p in points:
            near = sorted((float(np.sqrt(((np.array(p) - np.array(x)) ** 2).sum())), key) for key, x in rows)[:k]
            out[v, d] = [(round(a, 9), b) for a, b in near]
    return out


@pytest.mark.parametrize("dims, first", [(1, 10**6), (2, 40), (3, 10**6), (4, 25)])
def test_nearest_rows_of_several_pools(spark, monkeypatch, dims, first):
    """One scan over all pools equals all pairs, with ties, copies, a pool with few rows, and bounds found beforehand."""
    monkeypatch.setattr(privacy, "FIRST_ROWS", first)
    monkeypatch.setattr(privacy, "LEAF", 3)
    rnd = np.random.default_rng(dims)
    points = [(d, rnd.integers(0, 6, dims).astype(float).tolist()) for d in range(60)]
    pools = {v: [(1000 * v + i, rnd.integers(0, 6, dims).astype(float).tolist()) for i in range(n)] for v, n in ((0, 400), (1, 3), (2, 150))}
    names = [f"x{j}" for j in range(dims)]
    schema = ", ".join(f"{c} double" for c in names)
    att = spark.createDataFrame([(d, *p) for d, p in points], f"draw long, {schema}")
    pool = spark.createDataFrame([(v, key, *x, f"c{key % 3}") for v, rows in pools.items() for key, x in rows], f"v int, key long, {schema}, cat string").repartition(5)
    got = {}
    for r in privacy.nearest_rows(att, pool, names, ["cat"], "draw", "key", 5, "v").collect():
        assert r.p_cat == f"c{r.key % 3}"
        got.setdefault((r.v, r.draw), []).append((round(r.dist, 9), r.key))
    assert {k: sorted(v) for k, v in got.items()} == brute_nearest(points, pools, 5)


def test_nearest_rows_of_nothing(spark):
    att = spark.createDataFrame([], "draw long, x double")
    pool = spark.createDataFrame([(1, 2.0)], "key long, x double")
    assert privacy.nearest_rows(att, pool, ["x"], [], "draw", "key").collect() == []
    one = spark.createDataFrame([(0, 2.5)], "draw long, x double")
    assert privacy.nearest_rows(one, pool.where("false"), ["x"], [], "draw", "key").collect() == []
    assert [tuple(r) for r in privacy.nearest_rows(one, pool, ["x"], [], "draw", "key").collect()] == [(0, 1, 0.5)]


def test_mismatches_of_several_pools(spark):
    att = spark.createDataFrame([(0, "a", "x"), (1, "b", None)], "draw long, p string, q string")
    pool = spark.createDataFrame([(0, 1, "a", "y"), (0, 2, "c", "x"), (1, 3, "b", None), (1, 4, "z", "z")], "v int, key long, p string, q string")
    got = sorted(tuple(r) for r in privacy.knn_mixed_distance(att, pool, [], ["p", "q"], "draw", "key", variant="v").collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 0.0)]


def test_tree_prunes(monkeypatch):
    """A row meets few attackers once bounds are known."""
    rnd = np.random.default_rng(0)
    tree = privacy.AttackerTree(rnd.normal(size=(2000, 2)))
    assert (np.sort(tree.order) == np.arange(2000)).all()
    row, at, dist = tree.improving(rnd.normal(size=(50, 2)), np.full(2000, 0.05))
    assert (dist <= 0.05).all() and 0 < len(row) < 2000


# ---- search -----------------------------------------------------------------------------------

TRUE = TableSpec.from_dict({"fields": [
    {"name": "age", "type": "float", "distribution": "normal", "mean": 40, "std": 8},
    {"name": "team", "type": "category", "categories": ["blue", "green"], "probs": [0.7, 0.3]},
    {"name": "late", "type": "bool", "p": 0.4}]})


@pytest.fixture(scope="module")
def people(spark):
    return generate(spark, TRUE, 5, 500).withColumnRenamed("_id", "pid")


@pytest.mark.parametrize("objective, target", [("balanced", "late"), ("privacy", None), ("test_score", "late")])
def test_search_by_objective(spark, people, objective, target):
    start = TRUE.with_fields(age={"mean": 36.0})
    best, history = sweep.search(start, people, rounds=2, batch=2, budget=200, objective=objective, target=target, key="pid", seed=3)
    rows = history.orderBy("round", "candidate").collect()
    assert [(r.round, r.candidate) for r in rows] == [(r, c) for r in range(2) for c in range(3)]
    for r in rows:
        assert 0 <= r.realism <= 100 and 0 <= r.utility <= 100 and 0 <= r.privacy_risk <= 100
        want = {"balanced": 0.45 * r.realism + 0.35 * r.utility - 0.2 * r.privacy_risk, "privacy": 100 - r.privacy_risk, "test_score": r.utility / 100}[objective]
        assert r.objective == pytest.approx(want)
    top = [max(r.objective for r in rows if r.round == k) for k in range(2)]
    carried = [r.objective for r in rows if (r.round, r.candidate) == (1, 0)][0]
    assert carried == pytest.approx(top[0]) and top[1] >= top[0]  # the next round starts from the best of the last
    said = sweep.advice(history).first()
    assert said.first == rows[0].objective and said.best == max(top) and (said.advice.startswith("take") == (said.best > said.first))


def test_candidates_are_measured_as_if_alone(spark, people):
    """Scores of a batch equal those of each candidate by itself."""
    specs = [TRUE, TRUE.with_fields(age={"mean": 55.0}), TRUE.with_fields(team={"probs": (0.2, 0.8)})]
    goal = sweep.Objective(TRUE, people, target="late", key="pid", attackers=150)
    columns = ["candidate", "_id", *goal.columns]
    batch = {r.candidate: r for r in goal.scores(sweep.candidate_tables(spark, specs, 200, 7).select(columns), 3).collect()}
    for i, spec in enumerate(specs):
        alone = goal.scores(sweep.candidate_tables(spark, [spec], 200, 7).select(columns), 1).first()
        for field in ("objective", "realism", "utility", "privacy_risk"):
            assert alone[field] == pytest.approx(batch[i][field]), (i, field)
    assert batch[0].realism > batch[1].realism


def test_search_objectives_that_cannot_be(people):
    for kw in ({"objective": "balanced"}, {"objective": "privacy"}, {"objective": "fame", "key": "pid"}, {"objective": "test_score", "key": "pid"},
               {"key": "pid", "target": "nothing"}):
        with pytest.raises(ValueError):
            sweep.Objective(TRUE, people, kw.pop("objective", None), **kw)


def test_bounds_stay_in_order():
    spec = TableSpec.from_dict({"fields": [{"name": "n", "type": "float", "min": 1.0, "max": 1.05}]})
    rows = [{"field": "n", "param": "min", "idx": 0, "value": 1.1}, {"field": "n", "param": "max", "idx": 0, "value": 0.98}]
    assert (sweep.apply_parameters(spec, rows)["n"].min, sweep.apply_parameters(spec, rows)["n"].max) == (0.98, 1.1)
