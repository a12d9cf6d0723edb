"""Global order without a single task.

A plain ``Window.orderBy`` sends everything to one partition. Here the value axis is cut at
approximate quantiles (plain numbers on the driver, at most a few thousand), so the bucket of a
value is a deterministic function of the value. Running sums are then windows *inside* buckets plus
one offset per bucket. Every step works on distinct values, so a value that holds a third of all
rows is one row.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.sources.runtime import shuffle_width


def cut_points(df: DataFrame, columns: list[str], buckets: int | None = None) -> dict[str, list]:
    """Approximate quantile cuts of several columns in one scan.

    Text columns take theirs from a hash-ordered sample of distinct values of bounded size; the cuts
    only balance the buckets, they never decide a result.
    """
    buckets = buckets or shuffle_width(df.sparkSession)
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    cuts: dict[str, list] = {}
    for c in texts:
        some = df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(F.xxhash64(c), c).limit(20 * buckets)
        seen = sorted(r[0] for r in some.collect())
        cuts[c] = sorted({seen[i * len(seen) // buckets] for i in range(1, buckets)}) if seen else []
    numbers = [c for c in columns if c not in texts]
    if numbers:
        fractions = [i / buckets for i in range(1, buckets)]
        row = df.agg(*[
            F.percentile_approx(F.col(f"`{c}`").cast("double"), fractions, 10 * buckets).alias(f"c{i}")
            for i, c in enumerate(numbers)
        ]).first()
        for i, c in enumerate(numbers):
            cuts[c] = sorted({float(v) for v in (row[f"c{i}"] or [])})
    return cuts


def _numeric_bucket(df: DataFrame, value: str, edges: list, out: str) -> DataFrame:
    """How many edges are <= value, by the JVM-side binary search of ``Bucketizer``."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *[e for e in edges if not math.isinf(e)], float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    cutter = Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
    return cutter.transform(df).withColumn(out, F.col(out).cast("int"))


def with_bucket(df: DataFrame, value: str, cuts: dict[str, list] | list, group: str | None = None, out: str = "_bucket") -> DataFrame:
    """Add the ordered bucket of each value; with ``group`` every group has its own cuts."""
    per_group = cuts if group else {"": cuts}
    if any(isinstance(e, str) for edges in per_group.values() for e in edges):
        found = {g: F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(value))) for g, edges in per_group.items()}
        if not group:
            return df.withColumn(out, found[""])
    else:
        df = df.withColumn("_num", F.col(value).cast("double"))
        for i, edges in enumerate(per_group.values()):
            df = _numeric_bucket(df, "_num", edges, f"_cut{i}")
        found = {g: F.col(f"_cut{i}") for i, g in enumerate(per_group)}
    if group:
        choice = reduce(lambda acc, g: acc.when(F.col(group) == g, found[g]), found, F)
    else:
        choice = found[""]
    return df.withColumn(out, choice).drop("_num", *[f"_cut{i}" for i in range(len(per_group))])


def prefix_sums(
    df: DataFrame,
    value: str,
    weights: list[str],
    cuts: dict[str, list] | list,
    group: str | None = None,
    neighbours: bool = False,
) -> DataFrame:
    """Add ``<w>_before`` (sum over smaller values) and ``<w>_total`` for each weight column.

    ``df`` holds one row per (group, value); ``cuts`` is keyed by group if there is one. With
    ``neighbours`` the next smaller and larger values come along as ``previous`` and ``next``.
    """
    keys = [group] if group else []
    b = with_bucket(df, value, cuts, group)
    # One row per bucket: at most len(cuts) + 1 rows per group, so it may be broadcast.
    ends = [F.min(value).alias("_lo"), F.max(value).alias("_hi")] if neighbours else []
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights], *ends)
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    line = over.orderBy("_bucket")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(over).alias(f"{w}_total") for w in weights],
        *([F.lag("_hi").over(line).alias("_prev_hi"), F.lead("_lo").over(line).alias("_next_lo")] if neighbours else []),
    )
    ordered = Window.partitionBy(*keys, "_bucket").orderBy(value)
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    near = [F.lag(value).over(ordered).alias("_prev"), F.lead(value).over(ordered).alias("_next")] if neighbours else []
    ran = b.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_r_{w}") for w in weights], *near)
    # A left join: an inner one would push a null check to one side only and hide the shared shuffle.
    out = ran.join(F.broadcast(offsets), [*keys, "_bucket"], "left")
    done = [F.coalesce("_prev", "_prev_hi").alias("previous"), F.coalesce("_next", "_next_lo").alias("next")] if neighbours else []
    return out.select(
        *df.columns, *[f"{w}_total" for w in weights],
        *[(F.col(f"_r_{w}") + F.col(f"_o_{w}")).alias(f"{w}_before") for w in weights], *done)


# ---- exact quantiles by counting digits -------------------------------------------------------

DIGIT = 16
#: Columns of one scan: a task counts 65,536 digits of each.
TOGETHER = 32
#: Values of all wanted buckets together that may be fetched instead of counted once more.
FEW = 20_000


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles; both zeros are one value, and so are all not-a-numbers, the largest."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(values).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def keys_value(key: int) -> float:
    return float(np.array([key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(np.float64)[0])


def _cells(batch, column: int):
    values, weight = batch.column(column), batch.column(batch.num_columns - 1)
    known = np.asarray(values.is_valid())
    return ordered_keys(values.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.float64)), np.asarray(weight)[known]


def _count_digits(slots: list[tuple[int, int]], level: int):
    """(slot, digit, n, lo, hi): of the values that begin with a slot's digits so far, how many go on with each digit."""
    def run(batches):
        size, shift = 1 << DIGIT, 64 - DIGIT * (level + 1)
        n, lo, hi = np.zeros((len(slots), size), np.int64), np.full((len(slots), size), np.iinfo(np.int64).max), np.full((len(slots), size), np.iinfo(np.int64).min)
        for batch in batches:
            for slot, (column, begin) in enumerate(slots):
                keys, weight = _cells(batch, column)
                if level:
                    mine = keys >> (shift + DIGIT) == begin
                    keys, weight = keys[mine], weight[mine]
                digit = (keys >> shift) + (size // 2 if level == 0 else 0) & (size - 1)
                np.add.at(n[slot], digit, weight)
                np.minimum.at(lo[slot], digit, keys)
                np.maximum.at(hi[slot], digit, keys)
        for slot in range(len(slots)):
            at = np.flatnonzero(n[slot])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot), pa.int32()), pa.array(at.astype(np.int32)), pa.array(n[slot][at]),
                                              pa.array(lo[slot][at]), pa.array(hi[slot][at])], names=["slot", "digit", "n", "lo", "hi"])

    return run


def _fetch(slots: list[tuple[int, int]], level: int):
    """(slot, key, n) of the values that begin with a slot's digits."""
    def run(batches):
        for batch in batches:
            for slot, (column, begin) in enumerate(slots):
                keys, weight = _cells(batch, column)
                mine = keys >> (64 - DIGIT * level) == begin
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mine.sum()), slot), pa.int32()), pa.array(keys[mine]), pa.array(weight[mine])],
                                                 names=["slot", "key", "n"])

    return run


def exact_quantiles(df: DataFrame, columns: list[str], q: float, weight: str | None = None) -> DataFrame:
    """(field, q_value): linearly interpolated quantile of each numeric column; a column without values has no row.

    Values become longs of the same order, and their digits of 16 bits are counted from the top: every pass is one grouping
    of at most 65,536 counts for each wanted place, no value moves. A place is found when its bucket holds one value (ties end
    early), when few values are left (they are fetched), or after the fourth digit.
    """
    if len(columns) > TOGETHER:
        parts = [exact_quantiles(df, columns[i:i + TOGETHER], q, weight) for i in range(0, len(columns), TOGETHER)]
        return reduce(DataFrame.unionByName, parts)
    w = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)], w.alias("_w"))
    spark, level = df.sparkSession, 0
    found: dict[tuple[int, str], int] = {}  # (column, which end of the interpolation) to the key at its place
    part: dict[int, float] = {}
    # Open places: column, end, digits so far, place among the values with these digits.
    open_: list[tuple[int, str, int, int]] = [(i, end, 0, -1) for i in range(len(columns)) for end in ("low", "high")]
    while open_:
        slots = sorted({(i, begin) for i, _, begin, _ in open_})
        counted = cells.mapInArrow(_count_digits(slots, level), "slot int, digit int, n long, lo long, hi long").groupBy("slot", "digit").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        line = Window.partitionBy("slot").orderBy("digit")
        ran = counted.withColumn("before", F.sum("n").over(line) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("slot")))
        if level == 0:
            at = F.lit(float(q)) * (F.col("total") - 1)
            wanted = ran.select("*", at.alias("_at"), F.explode(F.array(*[
                F.struct(F.lit(e).alias("end"), x.cast("long").alias("place")) for e, x in (("low", F.floor(at)), ("high", F.ceil(at)))])).alias("p")).select("*", "p.*")
        else:
            places = F.array(*[F.struct(F.lit(slots.index((i, b))).alias("s"), F.lit(e).alias("end"), F.lit(place).cast("long").alias("place")) for i, e, b, place in open_])
            wanted = ran.withColumn("p", F.explode(F.filter(places, lambda x: x["s"] == F.col("slot")))).select("*", "p.end", "p.place")
        rows = wanted.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).collect()
        now, left = [], 0
        for r in rows:
            i, begin = slots[r["slot"]]
            if level == 0:
                part[i] = r["_at"] - math.floor(r["_at"])
            if r["lo"] == r["hi"]:
                found[i, r["end"]] = r["lo"]
            else:
                digit = r["digit"] - (1 << DIGIT - 1) if level == 0 else r["digit"]
                now.append((i, r["end"], (begin << DIGIT) + digit, r["place"] - r["before"]))
        left = sum({(r["slot"], r["digit"]): r["n"] for r in rows if r["lo"] != r["hi"]}.values())
        open_, level = now, level + 1
        if open_ and left <= FEW:
            slots = sorted({(i, begin) for i, _, begin, _ in open_})
            few = cells.mapInArrow(_fetch(slots, level), "slot int, key long, n long").toPandas().sort_values(["slot", "key"])
            for i, end, begin, place in open_:
                mine = few[few["slot"] == slots.index((i, begin))]
                found[i, end] = int(mine["key"].iloc[int(np.searchsorted(mine["n"].cumsum().to_numpy(), place, side="right"))])
            break
    out = []
    for i, c in enumerate(columns):
        if (i, "low") in found:
            low, high = keys_value(found[i, "low"]), keys_value(found[i, "high"])
            out.append((c, low if low == high else low + (high - low) * part[i]))
    return spark.createDataFrame(out, "field string, q_value double")


def neighbour_gaps(df: DataFrame, column: str) -> DataFrame:
    """(value, n, gap): distance of each distinct value to its nearest other value, null if there is none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    near = prefix_sums(counts, "value", ["n"], cut_points(df, [column])[column], neighbours=True)
    return near.select("value", "n", F.least(F.col("value") - F.col("previous"), F.col("next") - F.col("value")).alias("gap"))


# ---- row positions ----------------------------------------------------------------------------


@dataclass(frozen=True)
class OrderPlan:
    """Where each bucket of a column starts.

    ``edges`` cut the value axis. A value that fills several quantiles is *hot*: it is an edge itself and
    its rows form ``salts[b]`` slots of their own, ahead of the other rows of bucket ``b``.
    ``before[b][slot]`` is the number of rows ahead of a slot. All of this is a few numbers per bucket.
    """

    edges: list
    hot: list
    salts: list
    before: list
    total: int

    @property
    def only_hot(self) -> bool:
        """Whether every row has a hot value, so that all ranks are known from the plan."""
        ends = [*[starts[0] for starts in self.before[1:]], self.total]
        return bool(self.hot) and all(starts[-1] == end for starts, end in zip(self.before, ends, strict=True))


def _literal(values, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), ddl)


def _placed(df: DataFrame, column: str, edges: list, hot: list, salts: list, salt: Column) -> DataFrame:
    """Add ``_x`` (the value), ``_b`` (bucket), ``_hot`` and ``_slot``."""
    df = _numeric_bucket(df.withColumn("_x", F.col(f"`{column}`").cast("double")), "_x", edges, "_b")
    if not hot:
        return df.withColumn("_hot", F.lit(False)).withColumn("_slot", F.lit(0))
    k = F.get(_literal(salts, "array<int>"), F.col("_b"))
    df = df.withColumn("_hot", F.col("_x").isin(hot)).withColumn("_k", k)
    return df.withColumn("_slot", F.when(F.col("_hot"), F.pmod(salt, F.col("_k")).cast("int")).otherwise(F.col("_k"))).drop("_k")


def order_plans(df: DataFrame, columns: list[str], salt: Column, buckets: int | None = None) -> dict[str, OrderPlan]:
    """Plans of several numeric columns in two scans; only bucket totals reach the driver."""
    buckets = buckets or shuffle_width(df.sparkSession)
    fractions = [i / buckets for i in range(1, buckets)]
    row = df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), fractions, 10 * buckets).alias(f"c{i}")
        for i, c in enumerate(columns)]).first()
    shape, cells = {}, []
    for i, c in enumerate(columns):
        seen = Counter(float(v) for v in (row[f"c{i}"] or []))
        edges = sorted(seen)
        hot = [v for v in edges if seen[v] > 1]
        salts = [0] + [2 * seen[v] if seen[v] > 1 else 0 for v in edges]
        shape[c] = (edges, hot, salts)
        slots = _placed(df.where(F.col(f"`{c}`").isNotNull()), c, edges, hot, salts, salt)
        cells.append(slots.groupBy("_b", "_slot").agg(F.count(F.lit(1)).alias("n")).withColumn("_i", F.lit(i)))
    totals: dict = {}
    for r in reduce(DataFrame.unionByName, cells).collect():
        totals.setdefault(r["_i"], {})[(r["_b"], r["_slot"])] = r["n"]
    plans = {}
    for i, c in enumerate(columns):
        edges, hot, salts = shape[c]
        run, before = 0, []
        for b, k in enumerate(salts):
            starts = []
            for slot in range(k + 1):
                starts.append(run)
                run += totals.get(i, {}).get((b, slot), 0)
            before.append(starts)
        plans[c] = OrderPlan(edges, hot, salts, before, run)
    return plans


def _slots(plan: OrderPlan) -> list[str]:
    return ["_b", "_slot"] if plan.hot else ["_b"]


def _dealt(placed: DataFrame, plan: OrderPlan) -> DataFrame:
    """Slots dealt over all shuffle partitions: merged into one per core, they would hold a core's share of all rows in memory."""
    return placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *_slots(plan))


def _known_rank(df: DataFrame, column: str, plan: OrderPlan, out: str) -> DataFrame:
    """The average rank of rows of hot values, by their bucket; nulls get none."""
    placed = _placed(df, column, plan.edges, plan.hot, plan.salts, F.lit(0))
    starts = F.get(_literal(plan.before, "array<array<bigint>>"), F.col("_b"))
    first, end = F.get(starts, 0), F.element_at(starts, -1)
    return placed.withColumn(out, F.when(F.col("_x").isNotNull(), first + (end - first + 1) / F.lit(2.0))).drop("_x", "_b", "_hot", "_slot")


def add_rank(df: DataFrame, column: str, plan: OrderPlan, salt: Column, out: str, weight: str | None = None) -> DataFrame:
    """Add the 1-based average rank: one shuffle by bucket, none by value, and none at all if every value is hot.

    Rows of a hot value all have the same rank, known from the plan; their slots only spread them.
    """
    if plan.only_hot:
        return _known_rank(df, column, plan, out)
    placed = _placed(df, column, plan.edges, plan.hot, plan.salts, salt)
    w = F.col(weight) if weight else F.lit(1)
    # Nulls take part in nothing; they are spread over buckets of their own.
    placed = placed.withColumn("_b", F.when(F.col("_x").isNull(), F.lit(-1) - F.pmod(salt, F.lit(64)).cast("int")).otherwise(F.col("_b")))
    placed = _dealt(placed, plan)
    upto = Window.partitionBy(*_slots(plan)).orderBy("_x")
    peers = Window.partitionBy(*_slots(plan), "_x")
    starts = F.get(_literal(plan.before, "array<array<bigint>>"), F.col("_b"))
    cold = F.get(starts, F.col("_slot")) + F.sum(w).over(upto) - (F.sum(w).over(peers) - 1) / F.lit(2.0)
    if plan.hot:
        first, end = F.get(starts, 0), F.element_at(starts, -1)
        cold = F.when(F.col("_hot"), first + (end - first + 1) / F.lit(2.0)).otherwise(cold)
    return placed.withColumn(out, F.when(F.col("_x").isNotNull(), cold)).drop("_x", "_b", "_hot", "_slot")


def average_rank(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Attach 1-based average ranks to every row; nulls get none.

    Nulls and rows of hot values need no order at all, so only the other rows are shuffled.
    """
    salt = F.xxhash64(F.col(f"`{column}`"))
    plan = order_plans(df, [column], salt)[column]
    x = F.col(f"`{column}`").cast("double")
    apart = x.isNull() | (x.isin(plan.hot) if plan.hot else F.lit(False))
    if plan.only_hot:
        return _known_rank(df, column, plan, out)
    return add_rank(df.where(~apart), column, plan, salt, out).unionByName(_known_rank(df.where(apart), column, plan, out))


def dense_index(df: DataFrame, value: str, key: str, out: str = "idx") -> DataFrame:
    """Unique 0-based position of every row by (value, slot of the key hash, key); values must not be null.

    The order agrees with the value order; only ties of a hot value are dealt over several slots.
    """
    salt = F.xxhash64(F.col(f"`{key}`"))
    plan = order_plans(df, [value], salt)[value]
    placed = _dealt(_placed(df, value, plan.edges, plan.hot, plan.salts, salt), plan)
    starts = F.get(F.get(_literal(plan.before, "array<array<bigint>>"), F.col("_b")), F.col("_slot"))
    w = Window.partitionBy(*_slots(plan)).orderBy("_x", key)
    return placed.withColumn(out, (starts + F.row_number().over(w) - 1).cast("long")).drop("_x", "_b", "_hot", "_slot")


def key_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of every row in the order of a unique numeric key."""
    return dense_index(df, key, key, out)


# ---- sorted values by position ----------------------------------------------------------------


def run_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n, n_before, n_total): the sorted values of every column, run-length coded."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return prefix_sums(counts, "value", ["n"], cut_points(df, columns), group="field").select(
        "field", "value", "n", "n_before", "n_total")


def values_at(runs: DataFrame, asks: DataFrame, position: str, keep: list[str], buckets: int | None = None) -> DataFrame:
    """(field, position, keep..., value): the sorted value of a field at each asked 0-based position.

    ``runs`` comes from :func:`run_lengths`: a value covers positions ``n_before`` .. ``n_before + n - 1``.
    Run starts and asks are merged along the position axis in equal-width buckets that carry the last
    value of the bucket before, so a long run is never expanded. Asks should be spread over the axis, as
    ranks and uniform draws are; for anything else ask for distinct positions. ``runs`` is read several
    times, so pass a written table when it is large.
    """
    buckets = buckets or shuffle_width(runs.sparkSession)
    sizes = runs.groupBy("field").agg(F.greatest(F.ceil(F.max("n_total") / F.lit(float(buckets))), F.lit(1)).alias("_width"))
    kinds = {f.name: f.dataType for f in asks.schema.fields}
    starts = runs.select(
        "field", F.col("n_before").cast("long").alias("_p"), F.col("value").alias("_value"), F.lit(0).alias("_want"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in keep])
    wanted = asks.select("field", F.col(position).cast("long").alias("_p"), F.lit(None).cast("double").alias("_value"), F.lit(1).alias("_want"), *keep)
    # One row per field.
    merged = starts.unionByName(wanted).join(F.broadcast(sizes), "field").withColumn(
        "_b", F.floor(F.col("_p") / F.col("_width")).cast("int"))
    run = Window.partitionBy("field", "_b").orderBy("_p", "_want").rowsBetween(Window.unboundedPreceding, 0)
    filled = merged.withColumn("_run", F.last("_value", ignorenulls=True).over(run)).where("_want = 1")
    # At most buckets + 1 rows per field: the last value at or before the end of each bucket.
    ends = starts.join(F.broadcast(sizes), "field").groupBy("field", F.floor(F.col("_p") / F.col("_width")).cast("int").alias("_b")).agg(
        F.max_by("_value", "_p").alias("_last"))
    every = sizes.select("field", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("_b"))
    back = Window.partitionBy("field").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.join(ends, ["field", "_b"], "left").select("field", "_b", F.last("_last", ignorenulls=True).over(back).alias("_carry"))
    return filled.join(F.broadcast(carry), ["field", "_b"], "left").select(
        "field", F.col("_p").alias(position), *keep, F.coalesce("_run", "_carry").alias("value"))


def deal_values(df: DataFrame, by: str, key: str, plan: OrderPlan, runs: DataFrame, out: str) -> DataFrame:
    """Replace ``by`` with ``out``: the sorted values of ``runs`` (of one field) are dealt to the rows in the order of (by, key).

    A slot of the order covers known positions, so the runs that reach into them go to the same task as its rows: one shuffle,
    whatever other columns the rows carry. ``plan`` is that of ``by``, salted by the key's hash; ``by`` must not be null, and
    ``runs`` must cover as many positions as there are rows.
    """
    salt = F.xxhash64(F.col(f"`{key}`"))
    firsts, starts = [], []  # the number of a bucket's first slot, and the position at which each slot starts
    for mine in plan.before:
        firsts.append(len(starts))
        starts += mine
    last = {start: i for i, start in enumerate(starts)}  # of slots that start together all but the last are empty
    cuts = sorted(last)
    rows = _placed(df, by, plan.edges, plan.hot, plan.salts, salt).withColumn("_s", F.get(_literal(firsts, "array<int>"), F.col("_b")) + F.col("_slot"))
    marks = _marks(runs, cuts).withColumn("_s", F.get(_literal([last[c] for c in cuts], "array<int>"), F.col("_s")))
    asked = rows.drop("_b", "_hot", "_slot", by)
    both = _dealt_by_slot(asked.withColumn("_want", F.lit(1)).unionByName(marks, allowMissingColumns=True))
    upto = Window.partitionBy("_s").orderBy("_x", key).rowsBetween(Window.unboundedPreceding, 0)
    place = F.coalesce("_p", F.get(_literal(starts, "array<bigint>"), F.col("_s")) + F.sum("_want").over(upto) - 1)
    return _last_value(both.withColumn("_p", place), out).select(*[f"`{c}`" for c in df.columns if c != by], out)


def values_in_place(df: DataFrame, position: str, size: int, runs: DataFrame, out: str) -> DataFrame:
    """Replace ``position`` with ``out``: the value of ``runs`` (of one field, ``size`` positions) at each row's 0-based position.

    Rows meet the runs in stretches of equally many positions, in one shuffle, whatever other columns they carry. Positions should
    be spread over the axis, as for :func:`values_at`.
    """
    buckets = shuffle_width(df.sparkSession)
    width = max(1, -(-size // buckets))
    marks = _marks(runs, list(range(0, size, width)))
    asked = df.withColumn("_p", F.col(position).cast("long")).withColumn("_s", F.floor(F.col("_p") / F.lit(width)).cast("int")).drop(position)
    both = _dealt_by_slot(asked.withColumn("_want", F.lit(1)).unionByName(marks, allowMissingColumns=True))
    return _last_value(both, out).select(*[f"`{c}`" for c in df.columns if c != position], out)


def _marks(runs: DataFrame, cuts: list[int]) -> DataFrame:
    """(_s, _p, _value, _want): each run once for every stretch that it reaches into; stretches begin at the positions ``cuts``."""
    inner = [float(c) for c in cuts[1:]]
    ends = runs.select("value", F.col("n_before").cast("double").alias("_begin"), (F.col("n_before") + F.col("n") - 1).cast("double").alias("_end"))
    reach = _numeric_bucket(_numeric_bucket(ends, "_begin", inner, "_from"), "_end", inner, "_to").withColumn("_s", F.explode(F.sequence("_from", "_to")))
    # At most one run of a stretch does not begin in it; its mark stands at the stretch's first position.
    at = F.greatest(F.col("_begin").cast("long"), F.get(_literal(cuts, "array<bigint>"), F.col("_s")))
    return reach.select("_s", at.alias("_p"), F.col("value").alias("_value"), F.lit(0).alias("_want"))


def _dealt_by_slot(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "_s")


def _last_value(both: DataFrame, out: str) -> DataFrame:
    """Rows (``_want`` 1) with the value of the last mark (``_want`` 0) at or before their position ``_p`` in their stretch."""
    held = Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_at", 2 * F.col("_p") + F.col("_want")).withColumn(out, F.last("_value", ignorenulls=True).over(held)).where("_want = 1")


def value_at(df: DataFrame, position: str, runs: DataFrame, out: str) -> DataFrame:
    """Attach the sorted value at 0-based ``position`` to every row, whatever the positions are."""
    asks = df.select(F.lit(out).alias("field"), F.col(position).cast("long").alias("_q")).distinct()
    found = values_at(runs.withColumn("field", F.lit(out)), asks, "_q", []).select("_q", F.col("value").alias(out))
    return df.join(found, df[position] == found["_q"], "left").drop("_q")
