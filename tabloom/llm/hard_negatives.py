"""Hard negatives by exact integer scores, computed with the method of the Four Russians.

Vectors become integers and are kept as bit planes: plane b of a row has bit b of every component (two's complement), eight
components to a byte. Of an anchor, the sums of all 256 subsets of every eight components are tabulated once; a plane of a
candidate's score is then one lookup per byte, and the planes are added by shifting. No product is formed.

Rows are packed into pages of at most ``PAGE_ROWS`` and written once. Anchors and pages are dealt over a grid of cells, a block of
about ``BLOCK_ANCHORS`` anchors against a slot of about ``CELL_ROWS`` rows, so every cell is bounded and every (anchor, row)
pair is scored in one of them; a cell gives only its best few rows per anchor on. Positives come first; with their scores
known, a second walk over the cells finds the negatives.

Defined cases: rows without an id take no part, nor do those without a label, without a vector, or with a null or non-finite
component; an empty vector has every score 0; vectors of different lengths are compared as if the shorter one ended in zeros.
Repeated rows count as often as they stand there, also as anchors; rows that agree in score and id are taken in the order of
the written pages. Components outside the range of a long are cut to it, and scores are those of 64-bit arithmetic. An empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.sources.runtime import materialize

PAGE_ROWS = 4096
BLOCK_ANCHORS = 1024
CELL_ROWS = 1 << 18
#: Rows scored at once inside a cell: with a block of anchors, about a megabyte of sums.
STEP = 256
GROUP = 8

PAGE = "page long, n_anchors long, n long, dims int, bits int, ids binary, labels binary, anchors binary, planes binary"
ANCHOR = "at long, anchor_id long, label long, x binary"
FOUND = "at long, anchor_id long, place int, positive_id long, positive_score long, other_id long, other_at long, score long"


# ---- integers, planes, tables -----------------------------------------------------------------


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as a long, cut to the range of longs."""
    return np.clip(np.floor(scale * values.astype(np.float64)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def bit_planes(x: np.ndarray) -> np.ndarray:
    """[planes, groups, rows] of uint8 for rows of integers; the last plane holds the sign."""
    bits = 1 + max(int(max(x.max(), ~x.min())).bit_length(), 1) if x.size else 2
    dims = -(-x.shape[1] // GROUP) * GROUP
    padded = np.zeros((len(x), dims), np.int64)
    padded[:, :x.shape[1]] = x
    made = [np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)]
    return np.ascontiguousarray(made).reshape(bits, dims // GROUP, len(x))


def whole_rows(planes: np.ndarray, at: np.ndarray, dims: int) -> np.ndarray:
    """The integers of some rows again."""
    out = np.zeros((len(at), planes.shape[1] * GROUP), np.int64)
    for b in range(len(planes)):
        bit = np.unpackbits(np.ascontiguousarray(planes[b][:, at].T), axis=1, bitorder="little").astype(np.int64)
        out += (-bit if b == len(planes) - 1 else bit) << b
    return out[:, :dims]


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """[groups, 256, anchors]: for every byte the sum of the components whose bit it has."""
    groups = -(-anchors.shape[1] // GROUP)
    columns = np.zeros((groups * GROUP, len(anchors)), dtype)
    columns[:anchors.shape[1]] = anchors.T
    columns = columns.reshape(groups, GROUP, len(anchors))
    table = np.zeros((groups, 1 << GROUP, len(anchors)), dtype)
    for j in range(GROUP):
        table[:, 1 << j:2 << j] = table[:, :1 << j] + columns[:, j:j + 1]
    return table


def sum_type(anchors: np.ndarray, bits: int):
    """32 bits where no partial sum can leave them, else 64."""
    top = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max()) if anchors.size else 0.0
    return np.int32 if top * 2.0**bits < 2.0**31 else np.int64


def full_scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[rows, anchors]: lookups of every plane's bytes, from the sign downwards, shifted and added."""
    rows, groups = planes.shape[2], min(planes.shape[1], len(table))
    total = np.zeros((rows, table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(table[g], planes[b, g], axis=0, out=part, mode="clip")
            total += part
        if b == len(planes) - 1:
            np.negative(total, out=total)
    return total


# ---- pages and anchors ------------------------------------------------------------------------


def _pack(scale: float):
    def run(batches):
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, marks, vectors = batch.columns
            for lo in range(0, len(batch), PAGE_ROWS):
                v = vectors.slice(lo, PAGE_ROWS)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), 0))
                flat = v.flatten()
                cells = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(v)), sizes)
                good = np.asarray(v.is_valid()) & np.asarray(ids.slice(lo, PAGE_ROWS).is_valid()) & np.asarray(labels.slice(lo, PAGE_ROWS).is_valid())
                good[owner[~np.isfinite(cells)]] = False  # a null component is read as not a number
                keep = np.flatnonzero(good)
                if not len(keep):
                    continue
                dims = int(sizes[keep].max())
                x = np.zeros((len(v), dims), np.int64)
                inside = good[owner]
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                x[owner[inside], (np.arange(len(cells)) - first[owner])[inside]] = quantise(cells[inside], scale)
                planes = bit_planes(x[keep])
                take = pa.array(keep)
                a = np.asarray(pa.compute.fill_null(marks.slice(lo, PAGE_ROWS), False)).astype(np.uint8)[keep]
                yield pa.RecordBatch.from_pydict({
                    "page": pa.array([page], pa.int64()), "n_anchors": pa.array([int(a.sum())], pa.int64()), "n": pa.array([len(keep)], pa.int64()),
                    "dims": pa.array([dims], pa.int32()), "bits": pa.array([len(planes)], pa.int32()),
                    "ids": [np.asarray(ids.slice(lo, PAGE_ROWS).take(take)).astype(np.int64).tobytes()],
                    "labels": [np.asarray(labels.slice(lo, PAGE_ROWS).take(take)).astype(np.int64).tobytes()],
                    "anchors": [a.tobytes()], "planes": [planes.tobytes()]})
                page += 1

    return run


def pack_pages(embeddings: DataFrame, anchors: Column, scale: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Rows that take part, packed; the pages are written once, so a page's number names the same rows ever after."""
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("i"), F.col(f"`{label}`").cast("long").alias("l"),
                             anchors.alias("a"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    return materialize(rows.mapInArrow(_pack(scale), PAGE), "vectors")


def _planes_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], -1, row["n"])


def _anchor_rows(batches):
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
            x = whole_rows(_planes_of(row), at, row["dims"])
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(row["page"] * PAGE_ROWS + at, pa.int64()),
                "anchor_id": pa.array(np.frombuffer(row["ids"], np.int64)[at], pa.int64()),
                "label": pa.array(np.frombuffer(row["labels"], np.int64)[at], pa.int64()),
                "x": pa.array([v.tobytes() for v in x], pa.binary())})


# ---- cells ------------------------------------------------------------------------------------


class Cell:
    """A block of anchors and a slot of rows, these in ascending order of id (then of place)."""

    def __init__(self, block: pa.Table, pages: pa.Table):
        rows = pages.to_pylist()
        self.at = np.concatenate([r["page"] * PAGE_ROWS + np.arange(r["n"]) for r in rows])
        self.ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        self.labels = np.concatenate([np.frombuffer(r["labels"], np.int64) for r in rows])
        order = np.lexsort((self.at, self.ids))
        bits, groups = max(r["bits"] for r in rows), max(-(-r["dims"] // GROUP) for r in rows)
        self.planes = np.zeros((bits, groups, len(order)), np.uint8)
        start = 0
        for r in rows:
            p = _planes_of(r)
            self.planes[:len(p), :p.shape[1], start:start + r["n"]] = p
            self.planes[len(p):, :p.shape[1], start:start + r["n"]] = p[-1]  # the sign goes on upwards
            start += r["n"]
        self.at, self.ids, self.labels = self.at[order], self.ids[order], self.labels[order]
        self.planes = self.planes[:, :, order]
        self.anchor_at, self.anchor_id, self.anchor_label = (
            block.column(c).to_numpy().astype(np.int64) for c in ("at", "anchor_id", "label"))
        vectors = [np.frombuffer(b, np.int64) for b in block.column("x").to_pylist()]
        self.x = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for i, v in enumerate(vectors):
            self.x[i, :len(v)] = v


def best_below(cell: Cell, anchors: np.ndarray, rows: np.ndarray, most: int, top: np.ndarray, floor: np.ndarray, same: bool):
    """For every limit (a row of ``top`` [limits, anchors]) the ``most`` highest scores not above it and above ``floor``.

    Gives (limit, anchor, row, score) lists. Rows come in ascending order of id, so a score equal to the last one kept cannot
    replace it. ``same`` keeps rows with the anchor's label but for the anchor itself, else rows with another label count.
    """
    dtype = sum_type(cell.x[anchors], len(cell.planes))
    span = np.iinfo(dtype)
    table = subset_sums(cell.x[anchors], dtype)
    top, bound = np.clip(top, span.min, span.max).astype(dtype), np.clip(floor, span.min, span.max).astype(dtype)
    open_ = np.flatnonzero((top > bound).any(axis=1))
    kept = {p: tuple(np.zeros(0, np.int64) for _ in range(3)) for p in open_}
    for lo in range(0, len(rows), STEP):
        now = rows[lo:lo + STEP]
        score = full_scores(table, cell.planes[:, :, now])
        out = cell.at[now][:, None] == cell.anchor_at[anchors][None] if same else cell.labels[now][:, None] == cell.anchor_label[anchors][None]
        for p in open_:
            r, a = np.nonzero((score > bound[p]) & (score <= top[p]) & ~out)
            if not len(r):
                continue
            a, r, s = (np.concatenate(x) for x in zip(kept[p], (a, now[r], score[r, a].astype(np.int64)), strict=True))
            order = np.lexsort((r, -s, a))
            a, r, s = a[order], r[order], s[order]
            first = np.searchsorted(a, a, side="left")
            best = np.arange(len(a)) - first < most
            a, r, s = a[best], r[best], s[best]
            kept[p] = a, r, s
            full = np.flatnonzero(np.bincount(a, minlength=len(anchors)) == most)
            bound[p][full] = s[np.searchsorted(a, full, side="right") - 1]
    for p, (a, r, s) in kept.items():
        yield p, anchors[a], r, s


def _positives_in(most: int):
    def run(block: pa.Table, pages: pa.Table) -> pa.Table:
        if not block.num_rows or not pages.num_rows:
            return _found(None, [])
        cell, out = Cell(block, pages), []
        for label in np.unique(cell.anchor_label):
            anchors, rows = np.flatnonzero(cell.anchor_label == label), np.flatnonzero(cell.labels == label)
            lowest = np.full((1, len(anchors)), np.iinfo(np.int64).min)
            for _, a, r, s in best_below(cell, anchors, rows, most, ~lowest, lowest, same=True):
                out.append((a, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), r, s))
        return _found(cell, out)

    return run


def _negatives_in(most: int, low: int, high: int):
    def run(block: pa.Table, pages: pa.Table) -> pa.Table:
        if not block.num_rows or not pages.num_rows:
            return _found(None, [])
        cell, out = Cell(block, pages), []
        positives = block.column("positives").to_pylist()
        wide = max(map(len, positives))
        scores = np.zeros((wide, len(positives)), np.int64)
        ids, there = np.zeros_like(scores), np.zeros(scores.shape, bool)
        for i, mine in enumerate(positives):
            for p, x in enumerate(mine):
                scores[p, i], ids[p, i], there[p, i] = x["score"], x["other_id"], True
        top = np.where(there, (high * scores) // 100, -1)
        floor = np.where(there, -((-low * scores) // 100) - 1, -1)  # none is above a floor equal to its top
        for p, a, r, s in best_below(cell, np.arange(len(positives)), np.arange(len(cell.at)), most, top, floor, same=False):
            out.append((a, np.full(len(a), p), ids[p, a], scores[p, a], r, s))
        return _found(cell, out)

    return run


def _found(cell: Cell | None, parts: list) -> pa.Table:
    a, place, pid, pscore, r, s = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 6
    at, aid, oid, oat = (cell.anchor_at[a], cell.anchor_id[a], cell.ids[r], cell.at[r]) if cell else [np.zeros(0, np.int64)] * 4
    return pa.table({"at": at, "anchor_id": aid, "place": place.astype(np.int32), "positive_id": pid, "positive_score": pscore,
                     "other_id": oid, "other_at": oat, "score": s})


def grid(pages: DataFrame) -> tuple[int, int]:
    """Blocks of anchors and slots of pages: bounded cells, and enough of them to keep the cores busy."""
    n_pages, n_rows, n_anchors = pages.agg(F.count(F.lit(1)), F.sum("n"), F.sum("n_anchors")).first()
    blocks = max(1, -(-(n_anchors or 0) // BLOCK_ANCHORS))
    wanted = max(-(-(n_rows or 0) // CELL_ROWS), -(-3 * pages.sparkSession.sparkContext.defaultParallelism // blocks))
    return blocks, max(1, min(n_pages, wanted))


def over_cells(anchors: DataFrame, pages: DataFrame, blocks: int, slots: int, work) -> DataFrame:
    """``work`` on every block of anchors against every slot of pages."""
    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")).withColumn("slot", numbers(slots))
    right = pages.withColumn("slot", F.pmod(F.xxhash64("page"), F.lit(slots)).cast("int")).withColumn("block", numbers(blocks))
    left, right = (x.repartition(2 * blocks * slots, "block", "slot").groupBy("block", "slot") for x in (left, right))
    return left.cogroup(right).applyInArrow(work, FOUND)


def best(found: DataFrame, most: int) -> DataFrame:
    """The best of what the cells found, numbered from 1."""
    order = Window.partitionBy("at", "place").orderBy(F.desc("score"), "other_id", "other_at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` marks the rows to find negatives for. Their positives are the ``n_positives`` best other rows of the same label;
    of every positive, the ``n_negatives`` best rows of another label count whose score lies between ``low`` and ``high`` per cent of its own.
    """
    pages = pack_pages(embeddings, anchors, scale, vec_id, embedding, label)
    blocks, slots = grid(pages)
    rows = pages.where("n_anchors > 0").mapInArrow(_anchor_rows, ANCHOR)
    positives = best(over_cells(rows, pages, blocks, slots, _positives_in(n_positives)), n_positives)
    of_anchor = positives.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("positives"))
    known = rows.join(of_anchor, "at")
    negatives = best(over_cells(known, pages, blocks, slots, _negatives_in(n_negatives, low, high)), n_negatives)
    return negatives.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                            F.col("score").alias("negative_score"))
