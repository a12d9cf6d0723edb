"""Buckets of prefix shingles and what the second pass knows of earlier meetings."""

from pyspark.sql import functions as F

from tabloom.llm import jaccard_join


def prefixes(spark):
    held = {1: [10, 11, 12], 2: [20, 11, 12], 3: [30, 31, 12], 4: [40]}
    return spark.createDataFrame([(c, 9, p, s) for c, x in held.items() for p, s in enumerate(x)], "cid long, n int, place int, shingle long")


def test_buckets_move_their_rows_once(spark):
    shared = jaccard_join.shared_buckets(prefixes(spark).repartition(3))
    got = sorted((r.shingle, r.cid, r.place, r.lo, r.hi) for r in shared.collect())
    assert got == [(11, 1, 1, 1, 2), (11, 2, 1, 1, 2), (12, 1, 2, 1, 3), (12, 2, 2, 1, 3), (12, 3, 2, 1, 3)]
    assert shared._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_only_shingles_where_a_pair_can_have_met_are_named(spark):
    rows = prefixes(spark).where(F.col("shingle").isin(11, 12))
    got = {(r.cid, r.shingle): r.before for r in jaccard_join.with_before(rows).collect()}
    assert got == {(1, 11): [], (1, 12): [11], (2, 11): [], (2, 12): [11], (3, 12): []}


def test_places_further_ahead_are_not_named(spark):
    rows = spark.createDataFrame([(1, 9, p, p) for p in range(jaccard_join.BEFORE + 3)], "cid long, n int, place int, shingle long")
    got = {r.place: r.before for r in jaccard_join.with_before(rows).collect()}
    last = jaccard_join.BEFORE + 2
    assert got[last] == list(range(last - jaccard_join.BEFORE, last)) and got[0] == []
