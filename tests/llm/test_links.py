"""Numbers of links of the Jaccard join against all pairs by brute force."""

import pytest

from tabloom.llm import jaccard_join

from tests.llm.test_operators import brute_components, family_rows, shingles


@pytest.mark.parametrize("block", [128, 5])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = family_rows()
    rows += [(500 + k, rows[30][1]) for k in range(3)] + [rows[40]]
    sets = [shingles(t) for _, t in rows]
    want = brute_components(rows)
    links = [sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 85 * len(a | b)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.near_duplicates(df, n_links=True).collect()))
    assert got == sorted((i, *want[i], k) for (i, _), k in zip(rows, links, strict=True))
    assert max(links) > 20 and min(links) == 0


def test_buckets_hold_no_bits(spark, monkeypatch):
    """A class lies in many buckets: what is written and shuffled for each is its id, size and place."""
    held, plain = {}, jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: held.setdefault(label, plain(df, label)) if label == "buckets" else plain(df, label))
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert got == {i: c for (i, _), (_, c) in zip(rows, [want[i] for i, _ in rows], strict=True)}
    assert sorted(held["buckets"].columns) == ["cid", "hi", "lo", "n", "place", "shingle"] and held["buckets"].count() > 0
