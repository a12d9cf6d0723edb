"""Binary token files: ids of all documents in id order, packed by the adaptive range coder.

Rows are dealt once by ranges of ids, sorted inside, and encoded by the tokenizers library, each distinct unit of a
task once. A range becomes one file: blocks that are coded independently, each with its length and checksum, then an
index of the documents, then a footer. Files get names that no other attempt uses and count only when the committed
manifest lists them. Where a document starts in the whole sequence is the sum of the manifest's earlier files and of
the index's earlier rows.

Layout, all numbers little-endian: magic; per block <n ids, n bytes, crc32> as u32 and the packed ids; the index, a
zlib stream of the documents' ids (i64), whether they are null (u8) and their numbers of token ids (i64); a footer of index
place (u64), index bytes (u64), index crc32 (u32), ids per block (u32), token ids (u64), documents (u64), magic.

Defined cases: null is the empty text, which still has the end id; equal document ids are ordered by text; null ids
come first; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.llm import range_coder
from tabloom.llm.common import chunks
from tabloom.llm.pretokens import REMEMBERED, Library, Remembered, per_worker, units
from tabloom.llm.ranges import RANGE_CHARS, numbered_ranges
from tabloom.sources.runtime import scratch_path

MAGIC = b"TIDS0001"
END_ID = 2
FOOTER = struct.Struct("<QQIIQQ8s")
HEAD = struct.Struct("<III")


def open_file(path: str, mode: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(place)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)


class Writer:
    """One file; ids are packed whenever a full set of blocks is there."""

    def __init__(self, path: str, block: int = range_coder.BLOCK_IDS):
        self.path, self.block, self.out = path, block, open_file(path, "w")
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block * range_coder.LANES:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint16)])
        n = len(ids) if last else len(ids) // self.block * self.block
        for i, packed in enumerate(range_coder.encode(ids[:n], self.block)):
            head = HEAD.pack(min(self.block, n - i * self.block), len(packed), zlib.crc32(packed))
            self.out.write(head + packed)
            self.at += len(head) + len(packed)
        self.n_ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[str, int, int, int]:
        self.flush(True)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        index = zlib.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + nulls.tobytes() + np.array(self.counts, "<i8").tobytes(), 1)
        self.out.write(index + FOOTER.pack(self.at, len(index), zlib.crc32(index), self.block, self.n_ids, len(self.docs), MAGIC))
        self.out.close()
        return self.path, self.n_ids, len(self.docs), self.at + len(index) + FOOTER.size


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, place of its first token id in the file, its token ids) in order; checks every checksum."""
    with open_file(path, "r") as f:
        size = f.size()
        f.seek(size - FOOTER.size)
        place, n_index, crc, block, n_ids, n_docs, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(place)
        index = f.read(n_index)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path}: not a whole token file")
        index = zlib.decompress(index)
        docs = np.frombuffer(index, "<i8", n_docs).tolist()
        nulls = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs).tolist()
        counts = np.frombuffer(index, "<i8", n_docs, 9 * n_docs).tolist()
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a token file")
        ids, at, start, left = np.zeros(0, np.uint32), 0, 0, n_ids
        for doc, null, n in zip(docs, nulls, counts, strict=True):
            parts = []
            need = n
            while need:
                if at == len(ids):
                    ids, at = read_blocks(f, path, min(left, block * range_coder.LANES), block), 0
                    left -= len(ids)
                take = ids[at:at + need]
                parts.append(take)
                at += len(take)
                need -= len(take)
            yield None if null else doc, start, parts[0] if len(parts) == 1 else np.concatenate([*parts, ids[:0]])
            start += n
        if left or at != len(ids):
            raise ValueError(f"{path}: ids that belong to no document")


def read_blocks(f, path: str, n: int, block: int) -> np.ndarray:
    packed, todo = [], n
    while todo:
        n_ids, n_bytes, crc = HEAD.unpack(f.read(HEAD.size))
        data = f.read(n_bytes)
        if n_ids != min(todo, block) or zlib.crc32(data) != crc:
            raise ValueError(f"{path}: a damaged block")
        packed.append(data)
        todo -= n_ids
    return range_coder.decode(packed, n, block)


# ---- tables -----------------------------------------------------------------------------------


def write_tokens(documents: DataFrame, definition: str, folder: str | None = None, end_id: int = END_ID, range_chars: int = RANGE_CHARS,
                 remembered: int = REMEMBERED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns the committed manifest: range, path, n_ids, n_docs, n_bytes, start."""
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    shared, name = spark.sparkContext.broadcast(definition), uuid.uuid4().hex
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    dealt, n = numbered_ranges(rows, range_chars)
    dealt = dealt.select("_range", "_id", "_text").repartitionById(n, "_range").sortWithinPartitions("_range", F.asc_nulls_first("_id"), "_text")
    names = ["range", "path", "n_ids", "n_docs", "n_bytes"]

    def make():
        library = Library(shared.value)
        return library, Remembered(lambda new: [np.array(x, np.uint16).tobytes() for x in library.encode(new)], remembered)

    def write(batches):
        library, known = per_worker(f"ids:{name}", make)
        at, writer = None, None
        for batch in batches:
            ranges, docs, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in chunks([len(t) + 1 for t in texts]):
                for r, doc, ids in zip(ranges[lo:hi], docs[lo:hi], encode_texts(texts[lo:hi], known, library, end_id), strict=True):
                    if r != at:
                        if writer:
                            yield row(at, writer)
                        at, writer = r, Writer(f"{folder}/files/{r:08d}-{uuid.uuid4().hex}.tids")
                    writer.add(doc, ids)
        if writer:
            yield row(at, writer)

    def row(at, writer):
        return pa.RecordBatch.from_pydict(dict(zip(names, [[x] for x in (at, *writer.close())], strict=True)),
                                          pa.schema([("range", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in names[2:])]))

    dealt.mapInArrow(write, "range int, path string, n_ids bigint, n_docs bigint, n_bytes bigint").write.parquet(f"{folder}/manifest")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def encode_texts(texts: list[str], known: Remembered, library: Library, end_id: int) -> list[np.ndarray]:
    """Ids of every text and the end id, as 16-bit numbers; texts with a special token's string are encoded whole."""
    whole = {i for i, t in enumerate(texts) if library.mark is None or any(s in t for s in library.specials)}
    found = [units(t) if i not in whole else [] for i, t in enumerate(texts)]
    known.learn(found or [[]])
    end, get = np.uint16(end_id).tobytes(), known.__getitem__
    out = [np.frombuffer(b"".join(map(get, f)) + end, np.uint16) for f in found]
    for i in whole:
        ids = library.tokenizer.encode(texts[i], add_special_tokens=False).ids
        if max(ids, default=0) > range_coder.MAX_ID:
            raise ValueError("the format holds 16-bit ids")
        out[i] = np.array([*ids, end_id], np.uint16)
    return out


def read_tokens(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files."""
    names = [doc_id, "start", "n_tokens", "ids_crc32"]

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, start, ids in read_file(path):
                    rows.append((doc, first + start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    if len(rows) >= 10_000:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names)

    files = manifest.count()
    spread = manifest.select("path", "start", "range").repartitionById(max(1, files), F.col("range"))
    return spread.select("path", "start").mapInArrow(read, f"`{doc_id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(documents: DataFrame, definition: str, **options) -> DataFrame:
    """Writes all documents' token files to the shared folder and reads them back."""
    return read_tokens(write_tokens(documents, definition, **options), options.get("doc_id", "doc_id"))
