"""The distinct pre-tokens of a corpus as a table that is worked on once and joined back to the documents.

Documents are cut into units, pre-tokens or short runs of them, where they lie. A chunk of documents numbers its distinct units and
is written as two kinds of rows: one per document with its numbers, packed, and one per chunk and bucket with the
distinct units whose hash falls into the bucket. All rows of a bucket meet in one task, which works on every distinct
unit once, for the whole corpus, and answers each chunk for its own units only. Answers and documents of a chunk then
meet by the chunk's name. No occurrence of a unit is moved, only numbers and each chunk's distinct units.

Bounds: a chunk holds ``CHUNK_CHARS`` characters (a longer text is a chunk of its own), and there are as many buckets
as the length of all texts asks for, so the distinct units of a bucket have about ``BUCKET_CHARS`` characters at most.
A very common unit is one entry per chunk. The documents' numbers are written once, as a table bucketed by chunk, and are not
shuffled. Names of chunks are made anew by every attempt of a task; as the rows are
written before they are read, only those of committed attempts count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.llm.common import chunks, to_bytes
from tabloom.sources.runtime import scratch_path

#: Characters of the documents that share one numbering of units.
CHUNK_CHARS = 32_000_000
#: Characters of all texts for each bucket of distinct units.
BUCKET_CHARS = 8_000_000
#: Fixed value: buckets that Spark allows a table; more chunks share them.
MOST_FILES = 100_000
#: Bytes for which answers come in multiples: an id or a number of pieces.
WIDTH = 4


def planes(data: bytes, width: int) -> bytes:
    """All first bytes of the values of ``width`` bytes, then all second ones, and so on: alike bytes stand together."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, width).T).tobytes()


def values(data: bytes, width: int) -> bytes:
    """The way back from ``planes``."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).tobytes()


def pack_numbers(numbers: np.ndarray) -> bytes:
    return zlib.compress(planes(numbers.astype("<u4").tobytes(), 4), 1)


def unpack_numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(values(zlib.decompress(packed), 4), "<u4")


def pack_strings(parts: list[bytes], width: int = 1) -> bytes:
    """Byte strings, whose lengths are multiples of ``width``, as one compressed value: number, lengths, bytes."""
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zlib.compress(np.uint32(len(parts)).tobytes() + planes(lengths.tobytes(), 4) + planes(b"".join(parts), width), 1)


def unpack_strings(packed: bytes, width: int = 1) -> list[bytes]:
    data = zlib.decompress(packed)
    start = 4 + 4 * int(np.frombuffer(data, "<u4", 1)[0])
    lengths = np.frombuffer(values(data[4:start], 4), "<u4")
    bounds = np.cumsum(np.concatenate([[0], lengths]), dtype=np.int64).tolist()
    joined = values(data[start:], width)
    return [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pack_frequencies(numbers: np.ndarray) -> bytes:
    """The distinct numbers, as differences, and then how often each occurs."""
    distinct, often = np.unique(numbers, return_counts=True)
    return pack_numbers(np.concatenate([np.diff(distinct, prepend=np.uint32(0)), often]))


def unpack_frequencies(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = unpack_numbers(packed).reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class Numbers(dict):
    """Units to numbers in the order in which they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Chunk:
    """Documents that share one numbering of their distinct units."""

    def __init__(self):
        self.name, self.chars, self.numbers = uuid.uuid4().hex, 0, Numbers()

    def number(self, found: list[str]) -> np.ndarray:
        """The numbers of the units, in order."""
        return np.fromiter(map(self.numbers.__getitem__, found), np.uint32, len(found))

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, its units' numbers, its units), each packed."""
        names = [to_bytes(u) for u in self.numbers]
        bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
        order = np.argsort(bucket, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(places):
                yield int(bucket[places[0]]), pack_numbers(np.diff(places, prepend=0)), pack_strings([names[i] for i in places.tolist()])


def cut_documents(documents: DataFrame, cut: Callable, describe: str, pack: Callable, buckets: int, files: int, chunk_chars: int, doc_id: str, text: str) -> DataFrame:
    """Rows of documents (bucket is null) and of buckets' distinct units, as a table in the shared folder.

    The table is stored by chunk, so the documents meet their answers without being shuffled.

    ``cut(text)`` gives the units and a tuple for the columns that ``describe`` names (as DDL); ``pack`` turns a
    document's numbers, in order, into what is kept of them.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    ddl = f"chunk string, bucket int, places binary, packed binary, _id {kind}, {describe}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    more = len(schema) - 5

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def finish(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        for bucket, places, packed in chunk.by_bucket(buckets):
            yield batch_of([(chunk.name, bucket, places, packed, None, *[None] * more)])

    def run(batches):
        chunk = Chunk()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in chunks([len(t) if t else 1 for t in texts]):
                size = sum(len(t or "") for t in texts[lo:hi])
                if chunk.chars and chunk.chars + size > chunk_chars:
                    yield from finish(chunk)
                    chunk = Chunk()
                chunk.chars += size
                rows = []
                for i, t in zip(ids[lo:hi], texts[lo:hi], strict=True):
                    found, told = cut(t or "")
                    rows.append((chunk.name, None, None, pack(chunk.number(found)), i, *told))
                yield batch_of(rows)
        yield from finish(chunk)

    spark, name = documents.sparkSession, f"units_{uuid.uuid4().hex}"
    cells = documents.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, ddl)
    cells.write.option("path", scratch_path(spark, "units")).bucketBy(files, "chunk").saveAsTable(name)
    return spark.table(name)


def answer_units(rows: DataFrame, tell: Callable, buckets: int) -> DataFrame:
    """chunk, places, answers: ``tell()`` gives a function from distinct units to one byte string each,
    of a multiple of ``WIDTH`` bytes.

    A bucket's rows stream through one task, which keeps the bucket's answers: each distinct unit is asked for once.
    """

    def run(batches):
        ask, at, known = tell(), None, {}
        for batch in batches:
            names, numbers, places, packed = (c.to_pylist() for c in batch.columns)
            for lo, hi in chunks([len(p) for p in packed], 1_000_000):
                held = [unpack_strings(p) for p in packed[lo:hi]]
                for a, b in runs(numbers[lo:hi]):
                    if numbers[lo + a] != at:
                        at, known = numbers[lo + a], {}
                    new = list(dict.fromkeys(u for units in held[a:b] for u in units if u not in known))
                    known.update(zip(new, ask([u.decode("utf-8", "surrogatepass") for u in new]), strict=True))
                    out = [pack_strings([known[u] for u in units], WIDTH) for units in held[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo + a:lo + b]), pa.array(places[lo + a:lo + b], pa.binary()), pa.array(out, pa.binary())],
                                                     ["chunk", "places", "answers"])

    asked = rows.where("bucket IS NOT NULL").select("chunk", "bucket", "places", "packed")
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk string, places binary, answers binary")


def runs(values: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i


def through_vocabulary(documents: DataFrame, cut: Callable, describe: str, tell: Callable, use: Callable, schema: str, doc_id: str, text: str,
                       chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS, counted: bool = False) -> DataFrame:
    """One row per document, made from the answers to its units; each distinct unit of the corpus is asked for once.

    ``use(answers, numbers, told)`` gets the answers to a chunk's units by their numbers, every document's numbers in
    order (with ``counted`` its distinct numbers and how often each occurs) and a list for each column of ``describe``, and returns lists for the columns of ``schema`` behind the id.
    """
    chars = documents.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(1, -(-chars // bucket_chars))
    pack, unpack = (pack_frequencies, unpack_frequencies) if counted else (pack_numbers, unpack_numbers)
    files = min(MOST_FILES, max(1, 2 * -(-chars // chunk_chars)))
    rows = cut_documents(documents, cut, describe, pack, buckets, files, chunk_chars, doc_id, text)
    kind = documents.schema[doc_id].dataType.simpleString()
    ddl = f"`{doc_id}` {kind}, {schema}"
    out = to_arrow_schema(StructType.fromDDL(ddl))

    def meet(docs: pa.Table, answered: pa.Table) -> pa.Table:
        if not docs.num_rows:  # the answers of a chunk without documents do not exist
            return out.empty_table()
        numbers = [np.cumsum(unpack_numbers(p), dtype=np.int64) for p in answered.column("places").to_pylist()]
        answers: list = [b""] * sum(map(len, numbers))
        for places, packed in zip(numbers, answered.column("answers").to_pylist(), strict=True):
            for i, a in zip(places.tolist(), unpack_strings(packed, WIDTH), strict=True):
                answers[i] = a
        found = [unpack(p) for p in docs.column("packed").to_pylist()]
        made = use(answers, found, [docs.column(c).to_pylist() for c in docs.column_names[3:]])
        ids = docs.column("_id").combine_chunks()
        return pa.Table.from_arrays([ids, *[pa.array(v, f.type) for v, f in zip(made, list(out)[1:], strict=True)]], schema=out)

    docs = rows.where("bucket IS NULL").select("chunk", "packed", "_id", *rows.columns[5:])
    return docs.groupBy("chunk").cogroup(answer_units(rows, tell, buckets).groupBy("chunk")).applyInArrow(meet, ddl)
