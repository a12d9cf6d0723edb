"""Conditional category tables and draws from them, without a list of values anywhere."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions.rng import uniform
from tabloom.operators import profile, relational


@pytest.fixture(scope="module")
def pairs(spark):
    parent = F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string")))
    child = F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(23)).cast("string")))
    return spark.range(700).select(F.col("id").alias("_id"), parent.alias("parent"), child.alias("child"))


def brute(rows, alpha):
    kinds = sorted({"__null__" if c is None else c for _, c in rows})
    out = {}
    for p in {p for p, _ in rows if p is not None}:
        mine = ["__null__" if c is None else c for q, c in rows if q == p]
        for c in kinds:
            out[p, c] = (len(mine), (mine.count(c) + alpha) / (len(mine) + len(kinds) * alpha))
    return out


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_tables_agree_with_counting(pairs, alpha):
    want = brute([(r.parent, r.child) for r in pairs.collect()], alpha)
    full = {(r.parent_value, r.child_value): (r.samples, pytest.approx(r.prob)) for r in profile.conditional_category_table(pairs, "parent", "child", alpha).collect()}
    assert full == want
    sparse = profile.conditional_category_sparse(pairs, "parent", "child", alpha).collect()
    assert len(sparse) < len(want) + 7
    for r in sparse:
        if r.child_value is not None:
            assert want[r.parent_value, r.child_value] == (r.samples, pytest.approx(r.prob))
        else:
            unseen = [v for (p, c), v in want.items() if p == r.parent_value and (p, c) not in {(x.parent_value, x.child_value) for x in sparse}]
            assert all(v == (r.samples, pytest.approx(r.prob)) for v in unseen)


def test_draws_follow_the_running_shares(spark, pairs):
    """Each draw takes the first child whose running share exceeds it; unseen parents take an even place."""
    cpt = profile.conditional_category_table(pairs, "parent", "child")
    lists = {}
    for r in sorted(cpt.collect(), key=lambda r: (r.parent_value, r.child_value)):
        lists.setdefault(r.parent_value, []).append((r.child_value, r.prob))
    every = sorted({c for v in lists.values() for c, _ in v})
    rows = pairs.withColumn("parent", F.when(F.col("_id") % 5 == 0, "new").otherwise(F.col("parent"))).drop("child")
    drawn = relational.lookup_cpt_sample(rows, "parent", cpt, "drawn", 4).withColumn("u", uniform(4, "drawn", "_id")).collect()
    assert len(drawn) == 700
    for r in drawn:
        total, want = 0.0, None
        for c, p in lists.get(r.parent, []):
            total += p
            if total > r.u and want is None:
                want = c
        if r.parent in lists:
            assert r.drawn == (want or lists[r.parent][-1][0])
        else:
            assert r.drawn == every[int(r.u * len(every))]


def test_draws_with_nothing_known(spark, pairs):
    empty = spark.createDataFrame([], "parent_value string, child_value string, prob double")
    got = relational.lookup_cpt_sample(pairs.limit(5), "parent", empty, "drawn", 1).collect()
    assert [r.drawn for r in got] == ["unknown"] * 5
    assert profile.conditional_category_table(pairs.where("false"), "parent", "child").collect() == []


def test_no_lists_in_the_plans(pairs):
    cpt = profile.conditional_category_table(pairs, "parent", "child")
    drawn = relational.lookup_cpt_sample(pairs.drop("child"), "parent", cpt, "drawn", 4)
    for df in (cpt, drawn):
        plan = df._jdf.queryExecution().toString()
        assert "collect_set" not in plan and "collect_list" not in plan


def test_rows_are_not_sorted_for_a_small_table(spark, pairs, tmp_path):
    pairs.write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs")
    cpt = profile.conditional_category_table(rows, "parent", "child", 1.0)
    drawn = relational.lookup_cpt_sample(rows.drop("child"), "parent", cpt, "drawn", 4)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert drawn.count() == 700
