"""Helpers shared by the operators of this folder: batches, words, hashes, scratch files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Texts of about so many characters are worked on at once inside a task.
CHUNK_CHARS = 2_000_000

#: Bytes that belong to a word of the decontamination contract, lower-cased; all others part words.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Only A-Z is lower-cased; other bytes stay.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Odd 64-bit constants of the hash mixers (any odd numbers would do).
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
               dtype=np.uint64)


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and every character from U+0080 on."""
    return to_bytes(text).translate(ALNUM_TABLE).split()


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of anything but space and U+0009 to U+000D."""
    return to_bytes(text).translate(LOWER_TABLE).split()


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) ranges whose sizes add up to about ``limit``; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def cell_sizes(column: pa.Array) -> list[int]:
    """Characters (bytes, entries) of every cell, 1 at least, without making Python objects of the cells."""
    kind = column.type
    text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    count = pc.utf8_length if text else pc.list_value_length if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length
    return [n or 1 for n in count(column).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut by ``chunks`` of its column ``column``: Python never holds the strings of a whole batch."""
    for lo, hi in chunks(cell_sizes(batch.column(batch.schema.names.index(column)))):
        yield batch.slice(lo, hi - lo)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; wraps around on purpose."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every data[start:end], all at once: eight bytes of every word in each turn."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + MIX[0])
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo, at = np.arange(len(starts)), starts.copy()
    while len(todo):
        left = ends[todo] - at[todo]
        word = np.ascontiguousarray(eights[at[todo]]).view("<u8").ravel()
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        word = np.where(cut > 0, (word << cut) >> cut, word)
        out[todo] = mix((out[todo] ^ word) * MIX[3] + MIX[4])
        at[todo] += 8
        todo = todo[left > 8]
    return out


def blank_word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without space and bytes 9 to 13."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Distinct sorted hashes of all runs of ``size`` words; fewer words count as one run; none: empty."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = blank_word_bounds(data)
    return np.unique(join_words(word_hashes(data, starts, ends), size))


def join_words(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes (of the whole run if there are fewer)."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        out = mix(out * MIX[0] + words[i:len(words) - n + 1 + i])
    return out


def map_rows(df: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """Runs ``fn`` on lists of the named columns, chunk by chunk; it returns lists of the output's columns.

    ``columns[-1]`` is the text by whose length chunks are cut. Nothing moves between tasks.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, columns[-1]):
                made = fn(*[c.to_pylist() for c in piece.columns])
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, decide: Callable) -> DataFrame:
    """Rows of ``df``, all columns untouched, for which ``decide(texts)`` says true; nothing moves between tasks."""

    def run(batches):
        for batch in batches:
            mask = []
            for piece in pieces(batch, column):
                mask += decide(piece.column(piece.schema.names.index(column)).to_pylist())
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)
