"""Lines that stand in several documents are kept in the first of them only.

Two Bloom filters tell which lines may repeat: the first holds every key seen once, the second those seen again while they were
in the first. Tasks send the short hashes of their own distinct keys to the segment of the filters that holds them, and each
segment is filled by one task; nothing of a text moves. The second filter goes back to all tasks, and only keys that are in it
(repeats and a few false ones) are shuffled, as 128-bit digests with their document: an exact minimum and maximum of the
document ids confirms each and chooses the first holder. Documents without a suspected line are finished where they lie; the
others meet the list of the lines that they lose.

The filters have ``BITS_PER_LINE`` bits for every line of the corpus, so their false positives do not grow with it. They are
broadcast only up to ``MOST_BITS``; a corpus that asks for more than four times as many treats every key as suspected, which
costs the shuffle of all digests (some 40 bytes a line) and gives the same rows.

Defined cases: a null or empty text is one empty line; rows that share an id are one document, and so are all rows without an id,
which come after every other; a repeated row gives a row each time; keys with fewer than ``min_chars`` code points always stay;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import chunks, to_bytes
from tabloom.sources.runtime import materialize

#: Fixed values of the contract: what is stripped from both ends of a line, and the least length of a key that can repeat.
BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10

BITS_PER_LINE = 8
#: Bits of either filter at most (128 MB), for the broadcast and the driver.
MOST_BITS = 1 << 30
SEGMENT_BITS = 1 << 18
WORDS = SEGMENT_BITS // 64
#: Hashes that a task gathers before it sends them on.
GATHERED = 1 << 20


# ---- keys -------------------------------------------------------------------------------------


def key_digests(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For every line a digest of its key, or None if the key is too short to count."""
    out = []
    for line in to_bytes(text).lower().split(b"\n"):  # bytes.lower() changes A-Z alone
        key = line.strip(BLANK)
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars
        out.append(blake2b(key, digest_size=16).digest() if long else None)
    return out


def distinct_keys(text: str | None, min_chars: int) -> list[bytes]:
    return [k for k in dict.fromkeys(key_digests(text, min_chars)) if k is not None]


def short_hashes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of every digest."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, 0]


# ---- the two filters --------------------------------------------------------------------------


def places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, word in it and the two bits of the word of every hash."""
    one = np.uint64(1)
    word = (hashes >> np.uint64(12)) & np.uint64(WORDS - 1)
    mask = (one << (hashes & np.uint64(63))) | (one << ((hashes >> np.uint64(6)) & np.uint64(63)))
    return ((hashes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), word.astype(np.int64), mask


class Filters:
    """A segment of the filters of keys seen once and seen twice."""

    def __init__(self):
        self.once, self.twice = np.zeros(WORDS, np.uint64), np.zeros(WORDS, np.uint64)

    def add(self, hashes: np.ndarray, repeated: bool) -> None:
        """Distinct hashes of some documents; ``repeated`` if each of them has been there twice already."""
        _, word, mask = places(hashes, 1)
        seen = np.ones(len(hashes), bool) if repeated else (self.once[word] & mask) == mask
        np.bitwise_or.at(self.twice, word[seen], mask[seen])
        np.bitwise_or.at(self.once, word, mask)


def suspected(hashes: np.ndarray, twice: np.ndarray | None) -> np.ndarray:
    """Which hashes the second filter holds; without a filter all."""
    if twice is None:
        return np.ones(len(hashes), bool)
    segment, word, mask = places(hashes, len(twice))
    return (twice[segment, word] & mask) == mask


def _hashes_by_segment(segments: int, min_chars: int):
    def send(gathered):
        found, times = np.unique(np.concatenate(gathered), return_counts=True)
        segment = places(found, segments)[0]
        order = np.argsort(segment, kind="stable")
        found, times, segment = found[order], times[order], segment[order]
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        parts = [(int(segment[a]), found[a:b], times[a:b]) for a, b in zip(cuts, [*cuts[1:], len(found)])]
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([s for s, _, _ in parts], pa.int32()),
            "once": pa.array([h[n == 1].tobytes() for _, h, n in parts], pa.binary()),
            "more": pa.array([h[n > 1].tobytes() for _, h, n in parts], pa.binary())})

    def run(batches):
        gathered, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if keys := distinct_keys(text, min_chars):
                    gathered.append(short_hashes(keys))
                    n += len(keys)
                if n >= GATHERED:
                    yield send(gathered)
                    gathered, n = [], 0
        if gathered:
            yield send(gathered)

    return run


def _fill(sent: pa.Table) -> pa.Table:
    filters = Filters()
    for column in ("more", "once"):
        for hashes in sent.column(column).to_pylist():
            filters.add(np.frombuffer(hashes, np.uint64), column == "more")
    return pa.table({"segment": sent.column("segment").slice(0, 1), "twice": pa.array([filters.twice.tobytes()], pa.binary())})


def twice_filter(documents: DataFrame, text: str, min_chars: int, most_bits: int) -> np.ndarray | None:
    """[segments, words]: the filter of keys seen twice, or None if one that tells keys apart would be too large."""
    t = F.col(f"`{text}`")
    lines = documents.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    wanted = BITS_PER_LINE * lines
    if wanted > 4 * most_bits:
        return None
    segments = max(1, -(-min(wanted, most_bits) // SEGMENT_BITS))
    sent = documents.select(t).mapInArrow(_hashes_by_segment(segments, min_chars), "segment int, once binary, more binary")
    filled = sent.groupBy("segment").applyInArrow(_fill, "segment int, twice binary").collect()
    out = np.zeros((segments, WORDS), np.uint64)
    for row in filled:
        out[row["segment"]] = np.frombuffer(row["twice"], np.uint64)
    return out


# ---- confirmation and rewriting ---------------------------------------------------------------


def text_hash(text: str | None) -> int:
    """Tells texts of one id apart, so that a row meets only its own lines."""
    return int.from_bytes(blake2b(to_bytes(text), digest_size=8).digest(), "little", signed=True)


def _suspects(shared, min_chars: int):
    """(digest, doc, row) of every suspected key."""
    def run(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in chunks([len(t) if t else 1 for t in texts]):
                keys = [distinct_keys(t, min_chars) for t in texts[lo:hi]]
                flat = [k for mine in keys for k in mine]
                hit = suspected(short_hashes(flat), shared.value) if flat else np.zeros(0, bool)
                owner = np.repeat(np.arange(lo, hi), [len(k) for k in keys])[hit]
                own_hash = {i: text_hash(texts[i]) for i in set(owner.tolist())}
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array([flat[i] for i in np.flatnonzero(hit)], pa.binary()),
                    "doc": pa.array([ids[i] for i in owner], pa.int64()),
                    "row": pa.array([own_hash[i] for i in owner.tolist()], pa.int64())})

    return run


def _apart(shared, min_chars: int, with_suspects: bool, schema: pa.Schema):
    """Rows with a suspected line, or those without, with the hash of their text."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            picked = []
            for lo, hi in chunks([len(t) if t else 1 for t in texts]):
                keys = [distinct_keys(t, min_chars) for t in texts[lo:hi]]
                flat = [k for mine in keys for k in mine]
                hit = suspected(short_hashes(flat), shared.value) if flat else np.zeros(0, bool)
                owner = np.repeat(np.arange(hi - lo), [len(k) for k in keys])
                any_hit = np.bincount(owner[hit], minlength=hi - lo) > 0
                picked.append(any_hit if with_suspects else ~any_hit)
            at = np.flatnonzero(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
            take = pa.array(at)
            rows = pa.array([text_hash(texts[i]) for i in at] if with_suspects else [0] * len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns], rows], schema=schema)

    return run


def _rewrite(min_chars: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            ids, texts, drops = batch.columns
            n, gone, out = [], [], []
            for text, mine in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
                text, mine = text or "", set(mine or ())
                lines = text.split("\n")
                kept = [x for x, k in zip(lines, key_digests(text, min_chars), strict=True) if k not in mine] if mine else lines
                n.append(len(lines))
                gone.append(len(lines) - len(kept))
                out.append("\n".join(kept) if mine else text)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], schema=schema)

    return run


def drop_repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    number = F.coalesce(i.cast("long"), F.lit((1 << 63) - 1))
    shared = documents.sparkSession.sparkContext.broadcast(twice_filter(documents, text, min_chars, most_bits))
    found = materialize(documents.select(number.alias("doc"), t.alias("text")).mapInArrow(
        _suspects(shared, min_chars), "digest binary, doc long, row long"), "suspects")
    # Both lists are written: a join of two plain scans can split a line or a text that a third of all rows hold.
    repeats = materialize(found.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"), "repeats")
    drops = found.join(repeats, "digest").where("doc > first").groupBy("doc", "row").agg(F.collect_set("digest").alias("drops"))
    drops = materialize(drops, "drops")

    rows = documents.select(i.alias("doc_id"), number.alias("doc"), t.alias("text"))
    kind = StructType([*rows.schema.fields, StructField("row", LongType())])

    def apart(with_suspects):
        return rows.mapInArrow(_apart(shared, min_chars, with_suspects, to_arrow_schema(kind)), kind)

    met = apart(True).join(drops, ["doc", "row"], "left").select("doc_id", "text", "drops")
    rest = apart(False).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("drops"))
    result = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string"
    out = to_arrow_schema(documents.sparkSession.createDataFrame([], result).schema)
    return met.unionByName(rest).mapInArrow(_rewrite(min_chars, out), result)
