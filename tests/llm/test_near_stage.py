"""The near-duplicate stage of the pipeline against a brute force with five words and 0.8."""

import corpus_pipeline

from tests.llm.test_operators import family_rows, shingles


def brute_kept(rows, size=5, percent=80):
    """The smallest id of every component."""
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted(i for i in label if label[i] == i)


def spread_edits():
    """409 words, and the same with every 45th changed: five-word Jaccard 0.80, four-word Jaccard 0.837."""
    words = [f"w{k}" for k in range(409)]
    return [" ".join(words), " ".join("edit" + w if k % 45 == 22 else w for k, w in enumerate(words))]


def test_stage_takes_five_words_and_four_fifths(spark):
    rows = [(i, t) for i, t in family_rows() if any(c.isalpha() for c in t or "")]
    rows += [(10_000 + k, t) for k, t in enumerate(spread_edits())]
    one, two = (shingles(t, 4) for t in spread_edits())
    assert 100 * len(one & two) < 85 * len(one | two)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == brute_kept(rows) and 10_000 in got and 10_001 not in got
