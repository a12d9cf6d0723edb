"""Document fingerprints: bottom-k sketches of shingle hashes.

The fingerprint of a text keeps the ``k`` smallest 48-bit hashes of its distinct word shingles, as base64 text. Two
fingerprints give estimates of resemblance and containment, one gives the number of distinct shingles, and the
fingerprint of several parts is the bottom k of theirs, so they merge in any order.

``edited_fingerprints`` also makes, for every document, the text whose last half is replaced by the beginning of the
next document in descending id order. Rows are dealt once, by ranges of ids with cut points from quantiles; the first
row of every range is also sent to the range that comes before it in that order, so every row meets its follower
without a global sort in one task.

Defined cases: null is the empty text; the empty text has the empty fingerprint, like only to another empty one (1);
a text of fewer words than a shingle is one shingle; equal ids follow one another by text, descending; null ids come
last; the only row follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import LOWER_TABLE, blank_word_bounds, join_words, map_rows, to_bytes, word_hashes
from tabloom.llm.ranges import RANGE_CHARS, numbered_ranges

SHINGLE = 5
KEPT = 128
BITS = 48


# ---- sketches ---------------------------------------------------------------------------------


def sketches(texts: list[bytes], size: int = SHINGLE, kept: int = KEPT) -> list[np.ndarray]:
    """The bottom ``kept`` shingle hashes of every text, sorted."""
    joined = np.frombuffer(b"\n".join(texts).translate(LOWER_TABLE), np.uint8)
    starts, ends = blank_word_bounds(joined)
    words = word_hashes(joined, starts, ends)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, text_ends)
    first = np.concatenate([[0], last[:-1]])
    whole = join_words(words, size) >> np.uint64(64 - BITS) if len(words) >= size else words[:0]
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= size:
            h = whole[a:b - size + 1]
        else:
            h = join_words(words[a:b], size) >> np.uint64(64 - BITS)
        if len(h) > 4 * kept:  # repeats may leave fewer than k, then all hashes are looked at
            few = np.unique(np.partition(h, 3 * kept)[:3 * kept])
            if len(few) >= kept:
                out.append(few[:kept])
                continue
        out.append(np.unique(h)[:kept])
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).copy().view(">u8").ravel().astype(np.uint64)


def merge(parts: list[np.ndarray], kept: int = KEPT) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:kept] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of common shingles among those of both texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:kept] == 2).mean())


def distinct_shingles(a: np.ndarray, kept: int = KEPT) -> float:
    """Number of distinct shingles; exact below ``kept``."""
    return float(len(a)) if len(a) < kept else (kept - 1) * 2.0**BITS / float(a[kept - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of the first text's shingles that the second has too."""
    if not len(a):
        return 1.0
    alike, n = resemblance(a, b, kept), distinct_shingles(a, kept)
    return min(1.0, alike / (1 + alike) * (n + distinct_shingles(b, kept)) / n)


# ---- tables -----------------------------------------------------------------------------------


def fingerprints(documents: DataFrame, size: int = SHINGLE, kept: int = KEPT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimate) of every row; nothing moves."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def work(ids, texts):
        made = sketches([to_bytes(t) for t in texts], size, kept)
        return ids, [to_text(s) for s in made], [distinct_shingles(s, kept) for s in made]

    return map_rows(documents, [doc_id, text], work, f"`{doc_id}` {kind}, fingerprint string, n_shingles double")


def merge_fingerprints(df: DataFrame, key: str, fingerprint: str = "fingerprint", kept: int = KEPT) -> DataFrame:
    """One fingerprint per key: merged inside the tasks first, then over the tasks."""
    kind = df.schema[key].dataType.simpleString()

    def partly(frames):
        held: dict = {}
        for frame in frames:
            for k, part in frame.groupby("_key", dropna=False)["_print"]:
                k = None if pd.isna(k) else k
                held[k] = merge([*([held[k]] if k in held else []), *(from_text(x) for x in part if x is not None)], kept)
            if len(held) > 10_000:  # bounded: what is held goes on to the next stage
                yield pd.DataFrame([(k, to_text(s)) for k, s in held.items()], columns=["_key", "_print"])
                held = {}
        yield pd.DataFrame([(k, to_text(s)) for k, s in held.items()], columns=["_key", "_print"])

    def wholly(frame):
        return pd.DataFrame([(frame["_key"].iloc[0], to_text(merge([from_text(x) for x in frame["_print"]], kept)))], columns=[key, fingerprint])

    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{fingerprint}`").alias("_print"))
    return (rows.mapInPandas(partly, f"_key {kind}, _print string").groupBy("_key")
            .applyInPandas(wholly, f"`{key}` {kind}, `{fingerprint}` string"))


def with_followers(rows: DataFrame, range_chars: int) -> tuple[DataFrame, int]:
    """(_range, _ghost, _id, _text): every row in the range of its id, the first of each range also in the one before."""
    dealt, n = numbered_ranges(rows, range_chars)
    tops = [(r[0], r[1]) for r in dealt.select("_id", "_range").groupBy("_range").agg(F.max("_id")).orderBy("_range").collect()]
    # in descending order a range is followed by the next lower one, the lowest by the highest
    above = {tops[i][0]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    ghosts = rows.sparkSession.createDataFrame([(above[r], top, r) for r, top in tops] or [(0, None, 0)], "_to int, _top bigint, _range int").where(F.lit(bool(tops)))
    firsts = dealt.join(F.broadcast(ghosts), "_range").where(F.col("_id").eqNullSafe(F.col("_top")))
    own = dealt.select("_range", F.lit(False).alias("_ghost"), "_id", "_text")
    return own.unionAll(firsts.select(F.col("_to").alias("_range"), F.lit(True).alias("_ghost"), "_id", "_text")), n


def edited_fingerprints(documents: DataFrame, size: int = SHINGLE, kept: int = KEPT, range_chars: int = RANGE_CHARS,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    dealt, n = with_followers(rows, range_chars)
    dealt = dealt.repartitionById(n, "_range").sortWithinPartitions("_range", "_ghost", F.desc_nulls_last("_id"), F.desc("_text"))
    names = [doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pairs(batches):
        """Rows with the text that follows; the last row of a batch waits for the next batch."""
        before = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is not None and before[0] == row[0] and not before[1]:
                    yield before[2], before[3], row[3]
                before = row

    def work(batches):
        held, chars = [], 0
        for row in pairs(batches):
            held.append(row)
            chars += len(row[1]) + 1
            if chars > 2_000_000:
                yield made(held)
                held, chars = [], 0
        if held:
            yield made(held)

    def made(held):
        texts = [t for _, t, _ in held]
        edited = [to_bytes(t[:len(t) - len(t) // 2] + after[:len(t) // 2]) for _, t, after in held]
        own = sketches([to_bytes(t) for t in texts], size, kept)
        new = sketches(edited, size, kept)
        # the follower of a row is the next row but where a range ends
        follower = [own[i + 1] if i + 1 < len(held) and held[i][2] is texts[i + 1] else None for i in range(len(held))]
        for i, s in enumerate(follower):
            if s is None:
                follower[i] = sketches([to_bytes(held[i][2])], size, kept)[0]
        cells = [
            [i for i, _, _ in held], [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited],
            [to_text(s) for s in own], [to_text(s) for s in new],
            [resemblance(a, b, kept) for a, b in zip(own, new, strict=True)],
            [resemblance(a, b, kept) for a, b in zip(own, follower, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

    schema = f"`{doc_id}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(work, schema)
