"""Removal of near copies by row, where an id occurs on several texts or is null."""

from tabloom.llm import jaccard_join


def test_rows_are_removed_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a, "x"), (5, a + " end", "x"), (5, b, "x"), (7, c, "x"), (7, c + " end", "x"), (9, "!!! ", "x"), (9, None, "x"), (9, None, "x"),
            (11, None, "x"), (None, c, "n"), (None, "q r s t u", "n"), (None, "q r s t u", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(2)
    kept = [tuple(r) for r in jaccard_join.keep_one(df).collect()]
    assert (3, a, "x") in kept and (5, b, "x") in kept and (5, a + " end", "x") not in kept
    assert len([r for r in kept if r[0] == 7]) == 1
    assert len([r for r in kept if r[0] == 9]) == 2 and len([r for r in kept if r[0] is None]) == 3
    assert len(kept) == 9
