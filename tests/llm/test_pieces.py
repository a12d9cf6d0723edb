"""Batches are cut before their texts become Python strings."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tabloom.llm import common, jaccard_join


def test_cells_count_characters_bytes_and_entries():
    assert common.cell_sizes(pa.array(["aé", None, ""])) == [2, 1, 1]
    assert common.cell_sizes(pa.array([b"abc", None])) == [3, 1]
    assert common.cell_sizes(pa.array([[1, 2], [], None])) == [2, 1, 1]


def test_only_one_piece_of_a_batch_is_held_as_strings(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"n": np.arange(4000), "text": ["word " * 400] * 4000})

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run([batch]))

    monkeypatch.setattr(common.F, "col", lambda name: name)
    tracemalloc.start()
    out = common.map_rows(Frame(), ["n", "text"], lambda n, t: (n, [len(x) for x in t]), "n bigint, size bigint")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 4000 and sum(b.column(1).to_pylist() == [2000] * b.num_rows for b in out) == len(out)
    assert peak < 6_000_000  # the strings of the whole batch are 8 MB


def test_shingle_counts_of_all_documents(spark, monkeypatch):
    texts = spark.createDataFrame([("a b c d e",), ("a b c d",), (None,), ("a b c d",)], "_text string").repartition(2)
    counts = jaccard_join.shingle_counts(texts, 4)
    assert counts.sum() == 4 and sorted(counts[counts > 0].tolist()) == [1, 3]


def test_bit_filter_marks_every_digest_and_holds_only_its_bits(spark):
    digests = [jaccard_join.digest(np.array([i], np.uint64)) for i in range(300)]
    bits = jaccard_join.bit_filter(spark.createDataFrame([(bytearray(d),) for d in digests[:200]], "digest binary").repartition(3))
    assert jaccard_join.passes(bits, digests[:200]).all() and jaccard_join.passes(bits, digests[200:]).sum() < 5
    assert 200 < np.unpackbits(bits).sum() <= 400
