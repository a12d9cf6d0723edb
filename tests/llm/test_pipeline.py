"""The corpus pipeline against its parts by brute force, on a small table in files."""

import corpus_pipeline
import numpy as np
import pytest

from tabloom.llm import toxicity
from tests.llm.test_near_stage import brute_kept
from tests.llm.test_operators import brute_contamination, family_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, ("en", "de")[i % 2], "src", 0, "kept") for i, t in family_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join(rows[40][1].split()[:20])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages(spark, folder):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    first = set(brute_kept(list(kept.items()), size=5, percent=80))
    single = {i: t for i, t in kept.items() if i in first}
    clean = {i for i, t in single.items() if not brute_contamination(t, [(1, item)])[4]}
    want = [set(kept), set(kept), set(single), clean]
    now = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        made = stage(spark, now, path)
        assert made.columns == docs.columns
        got = made.collect()
        assert sorted(r.doc_id for r in got) == sorted(ids), name
        assert all(r.text == texts[r.doc_id] and r.extra == "kept" for r in got)
        now = spark.createDataFrame(got, docs.schema)
    assert len(clean) < len(single) < len(kept) < len(texts)
    final = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in final} == clean and all(r.decodes and r.n_tokens for r in final)


def test_order_of_the_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_language_told_reaches_the_next_stage(spark, folder, monkeypatch):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = ["der hund und die katze sind nicht im haus aber auf dem dach " * 2, "the dog and the cat are not in the house but on the roof " * 2]
    rows = [(i, texts[i % 2] + " abcdefgh"[: i % 9], None if i % 5 == 0 else "de" if i == 3 else ("de", "en")[i % 2], "src", 0, "kept") for i in range(60)]
    made = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, docs.schema), path)
    assert {(r.doc_id, r.lang) for r in made.collect()} == {(i, ("de", "en")[i % 2]) for i in range(60)}
    model = {"bits": 4, "row_of": np.zeros(16, np.int32), "tables": [[np.zeros((1, 1), np.float32)] * w for w in toxicity.WIDTHS], "shift": np.zeros((3, 1), np.float32),
             "weights": np.zeros(3, np.float32), "bias": np.float32(0), "language": np.zeros((1, 2), np.float32), "names": ["de", "en"], "levels": np.array([-1, 1, 1], np.float32)}
    monkeypatch.setattr(toxicity, "train", lambda *_: model)  # all texts have one score; German ones are over their threshold
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, made, path).collect()} == set(range(1, 60, 2))
