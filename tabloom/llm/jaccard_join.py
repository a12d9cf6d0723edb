"""N-gram Jaccard self-join: rare-first prefix filtering, and the components of its links.

A document is the set of its word shingles (64-bit hashes). Equal sets are one class; everything after works on
classes. With all shingles in one global order, two sets of Jaccard similarity t or more share one of their first
``n - ceil(t * n) + 1``, whatever the order; rare shingles first make these prefixes selective. How rare a shingle is
comes from counts in a table of fixed size (a hash bucket holds the sum of its shingles), which all documents fill.

Classes that share a prefix shingle meet by a join on it, under the length, the positional and a first suffix filter:
each class has ``64 * WORDS`` bits, the parity of its shingles in as many hash ranges, and two sets differ in at least
as many shingles as their bits differ. A second suffix filter compares the numbers of shingles in ``PARTS`` hash ranges,
which bounds the overlap also of long texts. What is left is verified once per pair on the whole sets; these are made by another scan, only for classes that pass a bit filter of the
candidates.

Groups of near copies are not expanded into all pairs. First every class of a bucket meets only the bucket's lowest
and highest class, and the links found give components. Then only classes of different components can matter: in
each bucket those outside its commonest component meet all of other components. A pair that met at one of the
``BEFORE`` shingles just before this one in both prefixes is not made again here. So every link between components is
found, and the components are those of the full join.

Numbers of links, where asked for, count every pair: both ends of a link lie in one component, so inside each component
all pairs of classes are verified on their whole sets, block against block, and only sums leave a task. A row's number
is that of the other rows whose sets are alike, rows with an equal set among them.

Defined cases: null is the empty text; a text without words has no shingle and no link and is its own component; a
text of fewer words than a shingle is one shingle; repeated rows fall into one class; a component's id is its smallest
document id, null ids aside; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tabloom.llm.common import LOWER_TABLE, blank_word_bounds, join_words, map_rows, pieces, to_bytes, word_hashes
from tabloom.sources.runtime import materialize

SIZE = 4
PERCENT = 85
#: Buckets of the shingle counts, 2 ** COUNT_BITS; the table is one byte each once it is broadcast.
COUNT_BITS = 22
#: Bits of the candidate filter; more candidates only let more sets pass.
FILTER_BITS = 25
#: Hash ranges of the suffix filter.
PARTS = 64
#: 64-bit words of parities in the first suffix filter.
WORDS = 8
#: Preceding prefix places by which a pair that has met already is known; others are met again, never missed.
BEFORE = 16
SEGMENTS = 64
#: Classes of a component in one block, about; a task holds the sets of two.
BLOCK = 128
#: Shingles that are counted at once in a pair of blocks.
COUNTED = 4096


# ---- sets -------------------------------------------------------------------------------------


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data = [to_bytes(t) for t in texts]
    joined = np.frombuffer(b"\n".join(data).translate(LOWER_TABLE), np.uint8)
    starts, ends = blank_word_bounds(joined)
    words = word_hashes(joined, starts, ends)
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in data]))
    whole = join_words(words, size) if len(words) >= size else words[:0]
    for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True):
        yield np.unique(whole[a:b - size + 1] if b - a >= size else join_words(words[a:b], size))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def needed(n: int, percent: int) -> int:
    """Shingles that a set of at least ``n`` shares with one of ``n`` if they are alike."""
    return -(-percent * n // 100)


def prefix(shingles: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    order = np.lexsort((shingles, rarity[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
    return shingles[order[:n - needed(n, percent) + 1]]


def part_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype("<u4")


def parities(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(6) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


# ---- tables of fixed size that all tasks fill --------------------------------------------------


def reduced(parts: DataFrame, dtype: str, size: int, join) -> np.ndarray:
    """One array from (segment, data) rows, each a packed stretch of the array, joined segment by segment."""

    def merge(frame):
        total = None
        for data in frame["data"]:
            part = np.frombuffer(zlib.decompress(data), dtype)
            total = part if total is None else join(total, part)
        return pd.DataFrame([(frame["segment"].iloc[0], zlib.compress(total.tobytes(), 1))], columns=["segment", "data"])

    out = np.zeros(size, dtype).reshape(SEGMENTS, -1)
    for segment, data in parts.groupBy("segment").applyInPandas(merge, "segment int, data binary").toLocalIterator():
        out[segment] = np.frombuffer(zlib.decompress(data), dtype)
    return out.ravel()


def segments(array: np.ndarray) -> pa.RecordBatch:
    rows = [zlib.compress(x.tobytes(), 1) for x in array.reshape(SEGMENTS, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(rows, pa.binary())], ["segment", "data"])


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles of each bucket occur in all documents."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[0]):
                hashes = np.concatenate([*shingle_sets(piece.column(0).to_pylist(), size), np.zeros(0, np.uint64)])
                np.add.at(total, (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
        yield segments(total)

    def add(a, b):
        both = a.astype(np.uint64) + b
        return np.minimum(both, 0xFFFFFFFF).astype(np.uint32)  # only the order matters, and only among equals here

    return reduced(texts.mapInArrow(count, "segment int, data binary"), "<u4", 1 << COUNT_BITS, add)


def filter_places(digests: list[bytes]) -> np.ndarray:
    words = np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4)[:, :2]
    return (words >> np.uint32(32 - FILTER_BITS)).astype(np.int64)


def bit_filter(wanted: DataFrame) -> np.ndarray:
    """Bits of all digests in the only column."""

    def mark(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at = filter_places(batch.column(0).to_pylist()).ravel()
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield segments(bits)

    return reduced(wanted.mapInArrow(mark, "segment int, data binary"), "u1", 1 << (FILTER_BITS - 3), np.bitwise_or)


def passes(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    at = filter_places(digests)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


# ---- the join ---------------------------------------------------------------------------------


def classes_of(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per distinct non-empty set: cid, digest, smallest id, rows, n, prefix, part counts, parities."""
    rarity = np.minimum(255, 8 * np.log2(1.0 + shingle_counts(texts.select("_text"), size))).astype(np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def work(ids, rows):
        out = [[], [], [], [], [], []]
        for i, s in zip(ids, shingle_sets(rows, size), strict=True):
            if len(s):
                for cells, v in zip(out, (i, digest(s), len(s), prefix(s, shared.value, percent).view(np.int64), part_counts(s).tobytes(), parities(s)), strict=True):
                    cells.append(v)
        return out

    rows = map_rows(texts, ["_id", "_text"], work, "_id bigint, digest binary, n int, prefix array<bigint>, parts binary, bits array<bigint>")
    one = rows.groupBy("digest").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"), F.first("bits").alias("bits"))
    classes = materialize(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    shared.unpersist()
    return classes


def alike(n: str, p: str, m: str, q: str, percent: int):
    """Length and positional filter: places p of n and q of m (from 0) hold the same shingle."""
    n, p, m, q = F.col(n), F.col(p), F.col(m), F.col(q)
    least = F.least(n, m)
    most = F.least(F.least(p, q) + F.least(n - p, m - q), least)
    # overlap o of sizes n, m is enough when 100 * o >= percent * (n + m - o)
    return (100 * least >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def few_apart(n: str, bits: str, m: str, other: str, percent: int):
    """Parity filter: of alike sets of n and m shingles so few are in one set only, and at least as many as bits differ."""
    apart = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m))


def ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def after_parity_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    one = classes.select(F.col("cid").alias("a"), "n", "bits")
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other_bits"))
    return pairs.join(one, "a").join(two, "b").where(few_apart("n", "bits", "m", "other_bits", percent)).select("a", "b")


def after_suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64) for i in (2, 3))
            most = np.minimum(a, b).sum(1)
            keep = (100 + percent) * most >= percent * (a.sum(1) + b.sum(1))
            yield batch.select([0, 1]).filter(pa.array(keep))

    one = classes.select(F.col("cid").alias("a"), F.col("parts").alias("parts_a"))
    two = classes.select(F.col("cid").alias("b"), F.col("parts").alias("parts_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "parts_a", "parts_b").mapInArrow(work, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of candidate pairs (a, b) of classes, those whose sets are alike; and (cid, shingles) of all classes in candidates."""
    pairs = materialize(after_suffix_filter(pairs, classes, percent), "candidates")
    asked = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).distinct()
    named = classes.select("cid", "digest").join(asked, "cid", "left_semi")
    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(named.select("digest")))

    def sets(rows):
        found = [(digest(s), s) for s in shingle_sets(rows, size) if len(s)]
        if not found:
            return [], []
        keep = passes(shared.value, [d for d, _ in found])
        got = {d: s for (d, s), k in zip(found, keep, strict=True) if k}
        return list(got), [s.tobytes() for s in got.values()]

    whole = map_rows(texts, ["_text"], sets, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    whole = materialize(named.join(whole, "digest").select("cid", "shingles"), "sets")
    shared.unpersist()

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = whole.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a"))
    right = whole.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint"), whole


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of every class with a link: the smallest class of its component.

    Labels go to neighbours and then jump to the label's label, so chains shrink by half and more each round.
    """
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("cid")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.v == labels.cid).groupBy(F.col("u").alias("cid")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "cid").select("cid", "label", F.least("label", "heard").alias("new"))
        jump = labels.select(F.col("cid").alias("new"), F.col("label").alias("jumped"))
        step = materialize(step.join(jump, "new").select("cid", "label", F.least("new", "jumped").alias("new")), "labels")
        changed = step.where("label <> new").limit(1).count()
        labels = step.select("cid", F.col("new").alias("label"))
        if not changed:
            return labels


def alike_in_run(n: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are alike, as a matrix; of two blocks only pairs across them."""
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], np.repeat(np.arange(len(sets)), n)[order]
    same = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, len(shingles), COUNTED):
        lo, hi = np.searchsorted(at, (first, first + COUNTED))
        held = np.zeros((len(sets), min(COUNTED, len(shingles) - first)), np.float32)
        held[owner[lo:hi], at[lo:hi] - first] = 1
        same += (held @ held.T).astype(np.int64)
    out = 100 * same >= percent * (n[:, None] + n - same)
    np.fill_diagonal(out, False)
    return out & (sides[:, None] != sides) if sides.min() < sides.max() else out


def link_sums(classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cid, linked): rows of other classes whose sets are like that of the class; classes without any are left out."""
    blocks = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = labels.join(blocks, "label").withColumn("side", F.pmod(F.xxhash64("cid"), "blocks"))
    dealt = dealt.join(classes.select("cid", "rows"), "cid").join(sets, "cid")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("label", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "cid", "side", "rows", "shingles")

    def runs(batches):
        key, held = None, []
        for batch in batches:
            cells = [c.to_pylist() for c in batch.columns]
            for label, lo, hi, *row in zip(*cells, strict=True):
                if (label, lo, hi) != key:
                    if held:
                        yield key, held
                    key, held = (label, lo, hi), []
                held.append(row)
        if held:
            yield key, held

    def count(batches):
        for (_, lo, hi), held in runs(batches):
            cids, sides, rows, shingles = zip(*held, strict=True)
            sides = np.array(sides)
            if lo < hi and sides.min() == sides.max():  # the other block is empty
                continue
            found = [np.frombuffer(x, "<u8") for x in shingles]
            linked = alike_in_run(np.array([len(x) for x in found]), sides, found, percent) @ np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(linked, pa.int64())], ["cid", "linked"])

    dealt = met.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    return dealt.mapInArrow(count, "cid bigint, linked bigint").groupBy("cid").agg(F.sum("linked").alias("linked"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows whose shingle several classes hold, with its lowest and highest class; they move once."""
    bucket = Window.partitionBy("shingle")
    return rows.withColumn("lo", F.min("cid").over(bucket)).withColumn("hi", F.max("cid").over(bucket)).where("lo < hi")


def with_before(mixed: DataFrame) -> DataFrame:
    """``before``: the class's shingles at the ``BEFORE`` places ahead of this one. Only those among the rows given are named, as a pair can have met at no other."""
    ahead = Window.partitionBy("cid").orderBy("place").rangeBetween(-BEFORE, -1)
    return mixed.withColumn("before", F.collect_list("shingle").over(ahead))


def linked_classes(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes, (cid, label) of those with a link to another class, and (cid, shingles) of at least those."""
    classes = classes_of(texts, size, percent)
    rows = classes.select("cid", "n", F.posexplode("prefix").alias("place", "shingle"))
    # A class lies in many buckets: its bits wait until the pairs are distinct.
    shared = materialize(shared_buckets(rows), "buckets")
    hubs = shared.where("cid = lo OR cid = hi").select("shingle", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"))
    near = alike("n", "place", "m", "at", percent)
    pairs = ordered_pairs(shared.join(hubs, "shingle").where((F.col("cid") != F.col("other")) & near))
    found, sets = verified(after_parity_filter(pairs, classes, percent), texts, classes, size, percent)
    links = materialize(found, "links")
    labels = components(links)
    # what is not yet in one component: in each bucket, all but its commonest component against the others
    told = shared.select("shingle", "cid", "n", "place").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    told = materialize(told, "told")
    by_label = told.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k"))
    commonest = by_label.groupBy("shingle").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = with_before(told.join(commonest.select("shingle", F.col("top.label").alias("main")), "shingle"))
    mixed = materialize(mixed.join(classes.select("cid", "bits"), "cid"), "mixed")
    minor = mixed.where("label <> main").select("shingle", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("bits").alias("other_bits"), F.col("label").alias("other_label"),
                                                F.col("before").alias("other_before"))
    # two classes outside the commonest component would meet twice
    once = (F.col("label") == F.col("main")) | (F.col("cid") < F.col("other"))
    near = near & few_apart("n", "bits", "m", "other_bits", percent)
    rest = ordered_pairs(mixed.join(minor, "shingle").where((F.col("label") != F.col("other_label")) & once & near & ~F.arrays_overlap("before", "other_before")))
    hub_pairs = ordered_pairs(shared.where("cid <> lo").select("cid", F.col("lo").alias("other")).unionAll(shared.where("cid <> hi").select("cid", F.col("hi").alias("other"))))
    found, others = verified(rest.join(hub_pairs, ["a", "b"], "left_anti"), texts, classes, size, percent)
    more = materialize(found, "links")
    sets = sets.unionAll(others.join(sets.select("cid"), "cid", "left_anti"))
    return classes, components(links.unionAll(more)) if more.limit(1).count() else labels, sets


def members(texts: DataFrame, size: int, percent: int, n_links: bool = False) -> DataFrame:
    """_id, n, digest, label and smallest id of the component, with ``n_links`` also links, of every row."""
    classes, labels, sets = linked_classes(texts, size, percent)
    named = classes.select("cid", "digest", "first_id", "rows").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component"))
    by_digest = named.join(smallest, "label")
    if n_links:
        by_digest = by_digest.join(link_sums(classes, labels, sets, percent), "cid", "left")
        by_digest = by_digest.withColumn("links", F.col("rows") - 1 + F.coalesce("linked", F.lit(0)))
    by_digest = by_digest.select("digest", "label", "component", *["links"] * n_links)

    def work(ids, rows):
        found = [*shingle_sets(rows, size)]
        return ids, [len(s) for s in found], [digest(s) if len(s) else None for s in found]

    return map_rows(texts, ["_id", "_text"], work, "_id bigint, n bigint, digest binary").join(by_digest, "digest", "left")


def named_texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_text"))


def near_duplicates(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", n_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and with ``n_links`` the number of other rows that it is alike to."""
    return members(named_texts(documents, doc_id, text), size, percent, n_links).select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"),
        *[F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links")] * n_links)


def keep_one(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every component one row, all columns: of its smallest id, and there of the smallest digest. Null ids stay.

    Rows are told apart by id and set, so an id may occur on several texts. Repeated rows of an id stay once; those
    without a shingle if all their columns are equal.
    """
    rows = members(named_texts(documents, doc_id, text), size, percent).where("_id IS NOT NULL").groupBy("_id", "digest", "label").agg(F.count(F.lit(1)).alias("k"))
    rows = materialize(rows, "members")
    first = rows.where("digest IS NOT NULL").groupBy("label").agg(F.min(F.struct("_id", "digest")).alias("first"))
    gone = rows.join(first, "label").where(F.struct("_id", "digest") != F.col("first")).select(F.col("_id").alias("_gone"), F.col("digest").alias("_gone_set"))

    def mark(batches):
        for batch in batches:
            sets = []
            for piece in pieces(batch, text):
                sets += [digest(s) if len(s) else None for s in shingle_sets(piece.column(piece.schema.names.index(text)).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], [*batch.schema.names, "_own_set"])

    marked = documents.mapInArrow(mark, StructType([*documents.schema.fields, StructField("_own_set", BinaryType())]))
    name = F.col(f"`{doc_id}`").cast("bigint")
    left = marked.join(gone, (name == F.col("_gone")) & (F.col("_own_set") == F.col("_gone_set")), "left_anti")
    often = rows.where("k > 1").select(F.col("_id").alias("_often"), F.col("digest").alias("_often_set"))
    if not often.limit(1).count():
        return left.drop("_own_set")
    same = (name == F.col("_often")) & F.col("_own_set").eqNullSafe(F.col("_often_set"))
    again = left.join(often, same, "left_semi")
    once = again.where("_own_set IS NOT NULL").dropDuplicates([doc_id, "_own_set"]).unionAll(again.where("_own_set IS NULL").dropDuplicates())
    return left.join(often, same, "left_anti").unionAll(once).drop("_own_set")
