"""Values dealt and looked up along an order, and the work of the copulas and of the neighbour threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tabloom.operators import order as O, privacy as P, relational as R


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("copula") / "rows")
    x = F.col("id")
    spark.range(3000).select(x.alias("k"), F.pmod(F.xxhash64(x), F.lit(40)).cast("double").alias("a"), (F.pmod(F.xxhash64(x, x), F.lit(9000)) / 7).alias("b"),
                             F.when(x % 3 > 0, 5.0).otherwise(x / 2).alias("y")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("by", ["a", "b", "y"])
def test_values_are_dealt_in_the_order_of_another_column(rows, by):
    plan = O.order_plans(rows, [by], F.xxhash64("k"))[by]
    got = O.deal_values(rows, by, "k", plan, O.run_lengths(rows, ["b"]), "v").toPandas().sort_values("k").reset_index(drop=True)
    held = rows.toPandas().sort_values("k").reset_index(drop=True)
    assert len(got) == len(held) and by not in got
    assert np.array_equal(np.sort(got["v"]), np.sort(held["b"]))
    # In the order of the column no value is smaller than one dealt to a smaller cell.
    spans = got.groupby(held[by])["v"].agg(["min", "max"]).sort_index()
    assert (spans["max"].to_numpy()[:-1] <= spans["min"].to_numpy()[1:]).all()


def test_values_in_place(rows):
    asks = rows.select("k", "a", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(3000)).alias("at"))
    for c in ("a", "b", "y"):
        got = O.values_in_place(asks, "at", 3000, O.run_lengths(rows, [c]), "v").toPandas().sort_values("k")
        at = asks.toPandas().sort_values("k")["at"].to_numpy()
        assert np.array_equal(got["v"].to_numpy(), np.sort(rows.toPandas()[c].to_numpy())[at]) and got.columns.tolist() == ["k", "a", "v"]


def test_reordering_brings_no_columns_together_by_key(rows):
    out = R.rank_copula_reorder(rows.select("a", (F.col("a") * 40 + F.col("b")).alias("b")), rows.select("k", "a", "b"), ["a", "b"], "k")
    assert "Join" not in plan_of(out)
    got, held = out.toPandas(), rows.toPandas()
    assert all(np.array_equal(np.sort(got[c]), np.sort(held[c])) for c in "ab") and got["a"].corr(got["b"]) > 0.5


def test_reordering_gives_rows_of_one_key_the_largest_and_drops_null_keys(rows):
    twice = rows.select("k", "a", "b").unionByName(rows.where("k < 5").select("k", "a", "b")).unionByName(rows.where("k = 9").select(F.lit(None).cast("long").alias("k"), "a", "b"))
    got = R.rank_copula_reorder(rows.select("a", "b"), twice, ["a", "b"], "k").toPandas()
    assert len(got) == 3005 and got.groupby("k")[["a", "b"]].nunique().to_numpy().max() == 1


def test_rows_are_drawn_once_for_the_copula(spark, sf):
    assert plan_of(queries()["generate_relational"](spark, sf)).count(":l_discount") <= 2  # both uniforms of one draw


def test_the_threshold_reads_written_distances(spark, monkeypatch):
    points = spark.range(9000).select((F.xxhash64("id") % 100003).cast("double").alias("x"), (F.xxhash64("id", "id") % 100019).cast("double").alias("y"))
    seen, exact = [], P.exact_quantiles
    monkeypatch.setattr(P, "exact_quantiles", lambda df, *args, **more: seen.append(plan_of(df)) or exact(df, *args, **more))
    got = P.self_nn_threshold(points, ["x", "y"], 0.1).first()[0]
    assert len(seen) == 2 and not any("Pandas" in p for p in seen)
    x = points.toPandas().to_numpy()
    near = np.array([np.sort(np.hypot(*(x - p).T))[1] for p in x])
    assert np.isclose(got, np.quantile(near, 0.1))


def test_cells_touched_and_pairs_found_are_all():
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(700, 2)), 2)
    cuts, radius = P.Cuts(x, 37), np.abs(draw.normal(size=700)) * 0.2
    home = dict(zip(*[c.tolist() for c in cuts.touched(x, np.zeros(700))]))
    met = set(zip(*[c.tolist() for c in cuts.touched(x, radius)]))
    assert len(home) == 700
    for i in range(0, 700, 7):
        near = np.flatnonzero(np.hypot(*(x - x[i]).T) <= radius[i])
        assert {(i, home[j]) for j in near} <= met
    tree, bound = P.AttackerTree(x[:301]), np.abs(draw.normal(size=301)) * 0.1
    found = set(zip(*[c.tolist() for c in tree.improving(x, bound)[:2]]))
    gap = np.sqrt(((x[:, None] - tree.points[None]) ** 2).sum(2))
    assert found == set(zip(*[c.tolist() for c in np.nonzero(gap <= bound)]))
