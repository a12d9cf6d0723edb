"""Pre-tokens of the corpus worked on once: against a plain loop, with chunks and buckets of all sizes."""

import pytest
from pyspark.sql import functions as F

from tabloom.llm import bpe, token_counts, vocabulary
from tabloom.llm.queries import vocabulary as vocabulary_file
from tests.llm.test_operators import by_id, odd_texts


def test_packed_values():
    import numpy as np

    assert vocabulary.unpack_strings(vocabulary.pack_strings([b"a\0", b"", b"\xff" * 70_000])) == [b"a\0", b"", b"\xff" * 70_000]
    assert vocabulary.unpack_strings(vocabulary.pack_strings([])) == []
    assert vocabulary.unpack_strings(vocabulary.pack_strings([b"abcd", b"", b"efghijkl"], 4), 4) == [b"abcd", b"", b"efghijkl"]
    distinct, often = vocabulary.unpack_frequencies(vocabulary.pack_frequencies(np.array([7, 3, 7, 900_000], np.uint32)))
    assert distinct.tolist() == [3, 7, 900_000] and often.tolist() == [1, 2, 1]
    none, never = vocabulary.unpack_frequencies(vocabulary.pack_frequencies(np.zeros(0, np.uint32)))
    assert len(none) == len(never) == 0


def test_numbers_of_a_chunk_lead_back_to_its_units():
    import numpy as np

    chunk, words = vocabulary.Chunk(), [f"w{i % 97}" for i in range(500)]
    numbers = chunk.number(words)
    named = {}
    for _, places, packed in chunk.by_bucket(5):
        named.update(zip(np.cumsum(vocabulary.unpack_numbers(places)).tolist(), vocabulary.unpack_strings(packed), strict=True))
    assert [named[n].decode() for n in numbers.tolist()] == words and len(named) == 97


@pytest.mark.parametrize(("chunk_chars", "bucket_chars"), [(50, 10_000_000), (10_000, 300), (16_000_000, 8_000_000)])
def test_every_unit_is_asked_for_once(spark, chunk_chars, bucket_chars):
    texts = [f"common w{i % 50} w{i % 7} w{i % 7} only{i}" for i in range(120)] + ["", None, "common", "common"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, bucket int").repartition(4)
    asked = spark.sparkContext.accumulator(0)

    def tell():
        def ask(new):
            asked.add(len(new))
            return [(u * 4).encode()[::-1] for u in new]
        return ask

    def use(answers, numbers, told):
        return [b"|".join(answers[i] for i in n.tolist()).decode() for n in numbers], told[0]

    got = by_id(vocabulary.through_vocabulary(df, lambda t: (t.split(), (len(t),)), "n int", tell, use, "back string, n int", "doc_id", "text", chunk_chars, bucket_chars))
    assert {i: r["back"] for i, r in got.items()} == {i: "|".join((w * 4)[::-1] for w in (t or "").split()) for i, t in enumerate(texts)}
    assert all(got[i]["n"] == len(t or "") for i, t in enumerate(texts))
    assert asked.value == len({w for t in texts for w in (t or "").split()})


def test_small_chunks_change_no_result(spark):
    import public_tokenizers as P

    texts = [*odd_texts(300), "long " * 40_000, "x" * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    definition, ranks = vocabulary_file("byte_bpe_50k.json").decode(), vocabulary_file("byte_bpe_50k.tiktoken")
    for fn, args in ((token_counts.token_counts, (definition,)), (bpe.digests, (ranks, P.PATTERN)), (bpe.encode_checked, (ranks, P.PATTERN))):
        want = by_id(fn(df, *args))
        assert len(want) == len(texts) and by_id(fn(df, *args, chunk_chars=500, bucket_chars=20_000)) == want
        assert fn(df.limit(0), *args).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (5, "a"), (5, "a"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("z")).withColumn("n_bytes", F.lit(0))
    got = token_counts.token_counts(df, vocabulary_file("byte_bpe_50k.json").decode()).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 3, 2), (0, 3, 2), (5, 0, 0), (5, 1, 1), (5, 1, 1)]
