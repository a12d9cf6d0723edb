"""Ranks, positions and distances against pandas and NumPy, with hot values."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.special import chi2_sf, kolmogorov_pvalue, norm_cdf, with_norm_ppf
from tabloom.operators import order as O, privacy as P, profile, realism


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, some are null."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(6000), "x": np.round(rng.normal(size=6000), 3), "y": rng.integers(0, 4, 6000).astype(float)})
    pdf.loc[pdf.id % 3 == 0, "x"] = 0.25
    pdf.loc[pdf.id % 50 == 1, "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, x double, y double")
    return df, pdf


def test_average_rank(skewed):
    df, pdf = skewed
    got = O.average_rank(df, "x").toPandas().sort_values("id")
    assert np.allclose(got["rank"].to_numpy(dtype=float), pdf.x.rank().to_numpy(), equal_nan=True)


def test_keyed_ranks_skip_nulls(skewed):
    df, pdf = skewed
    ranked, n = profile.with_ranks(df, ["x", "y"], "id")
    got = ranked.toPandas().sort_values("id")
    assert np.allclose(got.rank_x.to_numpy(dtype=float), pdf.x.rank().to_numpy(), equal_nan=True)
    assert n == {"x": int(pdf.x.notna().sum()), "y": 6000}


def test_spearman_with_ties(skewed):
    df, pdf = skewed
    got = {(r.a, r.b): r.value for r in profile.spearman_matrix(df, ["x", "y"]).collect()}
    want = pdf[["x", "y"]].dropna().corr("spearman").to_numpy()
    assert got[("x", "y")] == pytest.approx(want[0, 1], abs=1e-12) and got[("x", "x")] == 1.0


@pytest.mark.parametrize("column", ["x", "y"])
def test_ranks_of_many_rows_stay_in_their_slots(skewed, column):
    """Slots are not merged into a few tasks; a column of hot values alone is not sorted at all."""
    df, pdf = skewed[0].withColumn("y", F.pmod("id", F.lit(2)).cast("double")), skewed[1].assign(y=skewed[1].id % 2)
    salt = F.xxhash64("id")
    plan = O.order_plans(df, [column], salt)[column]
    ranked = O.add_rank(df, column, plan, salt, "rank")
    got = ranked.toPandas().sort_values("id")
    assert np.allclose(got["rank"].to_numpy(dtype=float), pdf[column].rank().to_numpy(), equal_nan=True)
    steps = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.only_hot == (column == "y") and ("Window" in steps) == ("Exchange" in steps) == (column == "x")
    if column == "x":
        assert ranked.rdd.getNumPartitions() == 4


def test_dense_index_is_a_sorted_permutation(skewed):
    df, _ = skewed
    got = O.dense_index(df.where("x is not null"), "x", "id").toPandas().sort_values("idx")
    assert list(got.idx) == list(range(len(got))) and got.x.is_monotonic_increasing


def test_values_by_position(spark, skewed):
    df, pdf = skewed
    runs = O.run_lengths(df, ["x"])
    asks = spark.range(500).select((F.col("id") * 7 % 3000).alias("pos"), "id")
    got = O.value_at(asks, "pos", runs, "v").toPandas()
    ref = np.sort(pdf.x.dropna().to_numpy())
    assert len(got) == 500 and np.array_equal(got.v.to_numpy(), ref[got.pos.to_numpy()])


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.987, 1.0])
def test_exact_quantiles(skewed, q):
    df, pdf = skewed
    got = O.exact_quantiles(df, ["x"], q).first()["q_value"]
    assert got == pytest.approx(np.quantile(pdf.x.dropna(), q), abs=1e-12)


def test_text_order(spark):
    words = [f"w{(i * 37) % 500:03d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words * 2], "w string")
    codes = {r.value: r.code for r in profile.category_codes(df, "w").collect()}
    assert [codes[w] for w in sorted(codes)] == list(range(500))


def test_ks_and_emd(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 700), 2), np.round(rng.normal(0.2, 1.3, 1100), 2)
    g, r = (spark.createDataFrame([(float(v),) for v in x], "x double") for x in (a, b))
    row = realism.ks_and_emd(g, r, ["x"]).first()
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b))
    assert row.ks_stat == pytest.approx(np.abs(fa - fb).max(), abs=1e-12)
    assert row.emd == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)), abs=1e-10)
    assert (row.n_gen, row.n_ref) == (700, 1100)


def brute_self_nn(x):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d.min(1)


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_self_nn_threshold_against_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(600, dims))
    x[:40] = rng.normal(size=(40, dims)) * 1e-4  # a dense knot
    x[40:60] = x[60:80]  # equal rows
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    for q in (0.1, 0.5):
        got = P.self_nn_threshold(df, cols, q).first()[0]
        assert got == pytest.approx(np.quantile(brute_self_nn(x), q), rel=1e-9, abs=1e-12)


def test_self_nn_with_columns_that_tell_little_apart(spark, monkeypatch):
    written = []
    keep = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label="stage": written.append(label) or keep(df, label))
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 2, 300), np.ones(300), np.ones(300), rng.uniform(size=300)], 1).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    got = P.self_nn_threshold(df, list("abcd"), 0.1).first()[0]
    assert got == pytest.approx(np.quantile(brute_self_nn(x), 0.1), rel=1e-9)
    assert len(written) == 2


def odd_points():
    rng = np.random.default_rng(8)
    clusters = np.concatenate([rng.normal(size=(200, 3)) * 1e-5 + c for c in rng.normal(size=(4, 3)) * 50] + [rng.normal(size=(60, 3)) * 40])
    return {
        "constant and few-valued": np.stack([np.ones(500), rng.integers(0, 3, 500), rng.uniform(size=500)], 1).astype(float),
        "clusters and far points": clusters,
        "a lattice of ties": np.stack(np.meshgrid(range(12), range(12), [0.0, 5.0]), -1).reshape(-1, 3).astype(float),
        "copies": np.repeat(rng.normal(size=(40, 3)), 7, axis=0),
        "one row": np.ones((1, 3)),
        "ten columns": rng.normal(size=(250, 10)),
    }


@pytest.mark.parametrize("name", odd_points())
@pytest.mark.parametrize("enough", [0.1, 1.0])
def test_self_nn_over_many_cells(spark, name, enough):
    """The same number of jobs for any columns; exact as far as was asked for, and nowhere too small."""
    x = odd_points()[name]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])]))
    got = np.sort([r.distance for r in P.self_nn_distances(df, df.columns, enough, cell_points=30).collect() for _ in range(r.n)])
    want = np.sort(brute_self_nn(x)) if len(x) > 1 else np.array([np.inf])
    sure = int(np.ceil(enough * (len(x) - 1))) + 1
    assert len(got) == len(want) and np.allclose(got[:sure], want[:sure], rtol=1e-9)
    assert (got >= want * (1 - 1e-9)).all()


def test_cuts_deal_points_evenly():
    x = np.random.default_rng(0).normal(size=(4000, 2))
    cuts = P.Cuts(x[:800], 16)
    row, cell = cuts.touched(x, np.zeros(len(x)))
    assert (np.sort(row) == np.arange(4000)).all() and cuts.cells == 16 and np.bincount(cell).max() < 500
    row, cell = cuts.touched(x, np.full(len(x), np.inf))
    assert len(row) == 16 * 4000


@pytest.mark.parametrize("few", [0, 20_000])
def test_quantiles_by_digits(spark, monkeypatch, few):
    """Values of any size and sign, ties, weights, nulls, a column of nulls and one value; every digit counted, or few values fetched."""
    monkeypatch.setattr(O, "FEW", few)
    rng = np.random.default_rng(2)
    wide = np.concatenate([rng.normal(size=150) * 10.0 ** rng.integers(-300, 300, 150), [0.0, -0.0, np.inf, -np.inf, 5e-324]])
    close = 1.0 + np.arange(len(wide)) % 40 * 2.0 ** -50
    weight = rng.integers(1, 5, len(wide))
    pdf = pd.DataFrame({"wide": wide, "close": close, "same": 7.25, "w": weight})
    df = spark.createDataFrame(pdf).withColumns({"gaps": F.when(F.col("w") > 2, F.col("close")), "none": F.lit(None).cast("double")}).repartition(4)
    for q in (0.0, 0.31, 0.5, 1.0):
        got = {r.field: r.q_value for r in O.exact_quantiles(df, ["wide", "close", "same", "gaps", "none"], q).collect()}
        assert set(got) == {"wide", "close", "same", "gaps"} and got["same"] == 7.25
        assert got["close"] == np.quantile(close, q, method="linear") or abs(got["close"] - np.quantile(close, q)) < 1e-15
        assert abs(got["gaps"] - np.quantile(close[weight > 2], q)) < 1e-15
        place = np.sort(wide)[[int(np.floor(q * (len(wide) - 1))), int(np.ceil(q * (len(wide) - 1)))]]
        assert place[0] <= got["wide"] <= place[1]
        heavy = O.exact_quantiles(df, ["close"], q, weight="w").first().q_value
        assert abs(heavy - np.quantile(np.repeat(close, weight), q)) < 1e-15


def test_quantile_plan_moves_counts_only(spark, monkeypatch):
    """More columns than one scan takes; nothing but (slot, digit) counts is grouped."""
    monkeypatch.setattr(O, "TOGETHER", 2)
    df = spark.range(1000).select(*[(F.col("id") * (i + 1)).alias(f"x{i}") for i in range(5)])
    got = {r.field: r.q_value for r in O.exact_quantiles(df, df.columns, 0.25).collect()}
    assert got == {f"x{i}": 249.75 * (i + 1) for i in range(5)}


def test_self_nn_all_distances(spark):
    x = np.random.default_rng(9).normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    got = np.sort([r.distance for r in P.self_nn_distances(df, ["a", "b"]).collect() for _ in range(r.n)])
    assert np.allclose(got, np.sort(brute_self_nn(x)))


def test_nearest_rows_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)  # several blocks of attackers
    monkeypatch.setattr(P, "CHUNK", 50)
    rng = np.random.default_rng(4)
    pool = pd.DataFrame({"key": range(400), "a": np.round(rng.normal(size=400), 1), "b": np.round(rng.normal(size=400), 1), "c": rng.choice(list("xyz"), 400)})
    att = pd.DataFrame({"draw": range(20), "a": np.round(rng.normal(size=20), 1), "b": np.round(rng.normal(size=20), 1), "c": rng.choice(list("xyz"), 20)})
    got = P.knn_mixed_distance(spark.createDataFrame(att), spark.createDataFrame(pool).repartition(5), ["a", "b"], ["c"], "draw", "key")
    got = {r.draw: r.distance for r in got.collect()}
    for _, q in att.iterrows():
        d = np.sqrt((pool.a - q.a) ** 2 + (pool.b - q.b) ** 2)
        near = pool.assign(d=d).sort_values(["d", "key"]).head(5)
        assert got[q.draw] == pytest.approx(float((near.d + (near.c != q.c)).min()), abs=1e-9)


def test_distance_without_numbers(spark):
    pool = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "p string, q string, key long")
    att = spark.createDataFrame([(0, "a", "y"), (1, "b", "y"), (2, "c", "z")], "draw long, p string, q string")
    got = P.knn_mixed_distance(att, pool, [], ["p", "q"], "draw", "key").orderBy("draw").collect()
    assert [r.distance for r in got] == [1.0, 0.0, 2.0]


def test_normal_functions(spark):
    p = [1e-9, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    rows = with_norm_ppf(df, {"z": F.col("p")}).withColumn("back", norm_cdf(F.col("z"))).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=5e-9 * 10) and r.back == pytest.approx(r.p, abs=1e-7)


def test_tails(spark):
    row = spark.range(1).select(
        chi2_sf(F.lit(3.841458820694124), F.lit(1)), chi2_sf(F.lit(5.991464547107979), F.lit(2)),
        chi2_sf(F.lit(30.14352720564616), F.lit(19)), chi2_sf(F.lit(0.0), F.lit(3)),
        kolmogorov_pvalue(F.lit(0.1), F.lit(400.0), F.lit(400.0)), kolmogorov_pvalue(F.lit(0.001), F.lit(50.0), F.lit(50.0))).first()
    assert list(row)[:3] == pytest.approx([0.05] * 3, abs=1e-6) and row[3] == 1.0 and row[5] == 1.0
    x = 0.1 * math.sqrt(200.0)
    assert row[4] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50)), abs=1e-12)
