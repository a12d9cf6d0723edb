"""Re-identification risk: nearest neighbours between attackers and a pool of rows."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.rng import laplace, uniform
from tabloom.operators.coerce import column_moments, number, numeric_columns, standardize
from tabloom.operators.order import exact_quantiles, key_index, neighbour_gaps
from tabloom.sources.runtime import materialize

BLOCK = 65_536  # attackers of one broadcast; more are done in further passes
CHUNK = 2048  # pool rows compared at once inside a task
LEAF = 16  # attackers in a leaf of the tree
MEETING = 1 << 20  # pairs of rows and attackers measured at once
MOST_CELLS, SAMPLED = 65_536, 16  # cells of distinct points at most, and points of the sample for each
FIRST_ROWS = 20_000  # about so many pool rows give the first bounds of a large pool


def sample_with_replacement(df: DataFrame, size: int, key: str, seed=0, label: str = "attackers") -> DataFrame:
    """``size`` draws with a ``draw`` number; each draw picks a row position by hash."""
    n = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    draws = df.sparkSession.range(size).select(
        F.col("id").alias("draw"), F.floor(uniform(seed, label, F.col("id")) * n).cast("long").alias("_pick"))
    indexed = key_index(df, key, "_row")
    return draws.join(indexed, draws["_pick"] == indexed["_row"]).drop("_pick", "_row")


def laplace_noise(df: DataFrame, columns: list[str], level: float, key: str, seed=0) -> DataFrame:
    """x + Laplace(0, level * std) with nulls read as 0 and a zero std as 1."""
    filled = {c: F.coalesce(number(df, c), F.lit(0.0)) for c in columns}
    stds = df.agg(*[F.stddev_pop(x).alias(c) for c, x in filled.items()])
    return df.withColumns({
        c: x + laplace(uniform(seed, f"noise/{c}", key), F.lit(float(level)) * F.coalesce(F.nullif(stds.select(c).scalar(), F.lit(0.0)), F.lit(1.0)))
        for c, x in filled.items()
    })


class AttackerTree:
    """A k-d tree over the attackers: boxes halved along their widest side, down to ``LEAF`` points."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple] = []  # (low, high, start, end, left, right)
        if len(points):
            self._grow(0, len(points))
        self.points = points[self.order]

    def _grow(self, start: int, end: int) -> int:
        mine = self.points[self.order[start:end]]
        low, high, at = mine.min(axis=0), mine.max(axis=0), len(self.nodes)
        self.nodes.append(())
        left = right = -1
        widest = int(np.argmax(high - low))
        if end - start > LEAF and high[widest] > low[widest]:
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(mine[:, widest], half)]
            left, right = self._grow(start, start + half), self._grow(start + half, end)
        self.nodes[at] = (low, high, start, end, left, right)
        return at

    def _arrays(self):
        """Boxes, ranges and children of all nodes as arrays, made once."""
        if not hasattr(self, "_flat"):
            low, high, *rest = zip(*self.nodes)
            self._flat = (np.array(low), np.array(high), *[np.array(c, np.int64) for c in rest])
        return self._flat

    def improving(self, x: np.ndarray, bound: np.ndarray):
        """(row, attacker place, distance) of all pairs whose distance is at most the attacker's bound.

        All pairs of rows and nodes of a level are looked at together; inside a node rows stay in ascending order.
        """
        found = []
        if self.nodes and len(x):
            low, high, start, end, left, right = self._arrays()
            leaf = left < 0
            far = np.zeros(len(self.nodes))
            far[leaf] = np.maximum.reduceat(bound, np.sort(start[leaf]))[np.argsort(np.argsort(start[leaf]))]
            for at in range(len(left) - 1, -1, -1):  # children come after their parent
                if not leaf[at]:
                    far[at] = max(far[left[at]], far[right[at]])
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(node):
                sq = np.zeros(len(node))
                for j in range(x.shape[1]):
                    v = x[rows, j]
                    gap = np.maximum(np.maximum(low[node, j] - v, v - high[node, j]), 0.0)
                    sq += gap * gap
                near = np.sqrt(sq) <= far[node] * (1 + 1e-9)  # the slack covers rounding only
                node, rows = node[near], rows[near]
                last = leaf[node]
                found += self._meet_leaves(x, bound, node[last], rows[last])
                node, rows = node[~last], rows[~last]
                node, rows = np.concatenate([left[node], right[node]]), np.concatenate([rows, rows])
        return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def _meet_leaves(self, x: np.ndarray, bound: np.ndarray, node: np.ndarray, rows: np.ndarray):
        """The pairs of rows and points of their leaves that are near enough, by leaves of one size, some at a time."""
        _, _, start, end, _, _ = self._arrays()
        size = end[node] - start[node]
        for n in np.unique(size):
            mine, step = np.flatnonzero(size == n), max(1, MEETING // int(n))
            for i in range(0, len(mine), step):
                some = mine[i:i + step]
                at = start[node[some]][:, None] + np.arange(n)
                sq = np.zeros(at.shape)
                for j in range(x.shape[1]):
                    diff = self.points[at, j] - x[rows[some], j][:, None]
                    sq += diff * diff
                dist = np.sqrt(sq)
                r, a = np.nonzero(dist <= bound[at])
                yield rows[some][r], at[r, a], dist[r, a]


def _nearest_in_task(shared, columns: list[str], key: str, variant: str, k: int):
    """A task's k nearest pool rows per variant and attacker, by (distance, key).

    ``shared`` holds the tree, the draws in its order and, per variant, bounds that no wanted distance exceeds.
    """
    def smallest(d: pd.DataFrame) -> pd.DataFrame:
        d = d.iloc[np.lexsort((d["_key"].to_numpy(), d["_dist"].to_numpy(), d["_at"].to_numpy()))]
        return d[d.groupby("_at", sort=False).cumcount() < k]

    def run(batches):
        tree, draws, first = shared.value
        best: dict[int, pd.DataFrame] = {}
        limits: dict[int, np.ndarray] = {}
        for pdf in batches:
            for number, rows in pdf.groupby(variant, sort=False):
                limit = limits.setdefault(number, first.get(number, np.full(len(draws), np.inf)).copy())
                for start in range(0, len(rows), CHUNK):
                    part = rows.iloc[start : start + CHUNK]
                    row, at, dist = tree.improving(part[columns].to_numpy(dtype=float), limit)
                    if not len(row):
                        continue
                    found = part.iloc[row].drop(columns=columns).reset_index(drop=True).rename(columns={key: "_key"})
                    found["_at"], found["_dist"] = at, dist
                    mine = best[number] = smallest(pd.concat([best[number], found], ignore_index=True) if number in best else found)
                    worst = mine.groupby("_at")["_dist"].agg(["size", "max"])
                    full = worst[worst["size"] == k]
                    limit[full.index.to_numpy()] = np.minimum(limit[full.index.to_numpy()], full["max"].to_numpy())
        for mine in best.values():
            out = mine.copy()
            out["_draw"] = draws[out["_at"].to_numpy()]
            yield out.drop(columns="_at")

    return run


def nearest_rows(attackers: DataFrame, pool: DataFrame, numeric: list[str], categorical: list[str], draw: str, key: str, k: int = 5,
                 variant: str | None = None) -> DataFrame:
    """(variant, draw, key, dist, p_<cat>...): the k nearest pool rows of each attacker over the numeric columns.

    ``variant`` numbers pools that lie in one table (noise levels, candidates): all are searched in the same scan. The pool
    stays where it is; the attackers, a sample of bounded size, go out as a tree in blocks of at most ``BLOCK``, and a pool row
    meets only those whose k nearest it can still improve. For a large pool, some ``FIRST_ROWS`` of its rows give bounds that
    all tasks start from. Tasks keep k rows per attacker, and a second top-k runs over those.
    """
    spark, tag = pool.sparkSession, variant or "_variant"
    cats = [f"p_{c}" for c in categorical]
    pool = pool if variant else pool.withColumn(tag, F.lit(0))
    slim = pool.select(F.col(tag).cast("int").alias("_variant"), *numeric, key, *[F.col(c).cast("string").alias(p) for c, p in zip(categorical, cats)])
    schema = T.StructType([
        T.StructField("_variant", T.IntegerType()), T.StructField("_key", pool.schema[key].dataType), *[T.StructField(p, T.StringType()) for p in cats],
        T.StructField("_dist", T.DoubleType()), T.StructField("_draw", T.LongType())])
    w = Window.partitionBy("_variant", "_draw").orderBy("_dist", "_key")

    def nearest(rows: DataFrame, shared) -> DataFrame:
        found = rows.mapInPandas(_nearest_in_task(shared, numeric, key, "_variant", k), schema)
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)

    numbered = attackers.select(F.col(draw).cast("long").alias(draw), *numeric)
    total, size = numbered.count(), slim.count()
    parts, after = [], None
    for _ in range(0, total, BLOCK):
        rest = numbered if after is None else numbered.where(F.col(draw) > after)
        block = rest.orderBy(draw).limit(BLOCK).toPandas()
        after = int(block[draw].iloc[-1])
        tree = AttackerTree(block[numeric].to_numpy(dtype=float))
        draws, first = block[draw].to_numpy()[tree.order], {}
        if size > 4 * FIRST_ROWS:
            some = slim.where(uniform(0, "bounds", key) < F.lit(FIRST_ROWS / size))
            rows = nearest(some, spark.sparkContext.broadcast((tree, draws, {}))).where(F.col("_n") == k).select("_variant", "_draw", "_dist").toPandas()
            place = pd.Series(np.arange(len(draws)), index=draws)
            for number, mine in rows.groupby("_variant"):
                first[number] = np.full(len(draws), np.inf)
                first[number][place[mine["_draw"]].to_numpy()] = mine["_dist"].to_numpy()
        parts.append(nearest(slim, spark.sparkContext.broadcast((tree, draws, first))))
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return best.select(*([F.col("_variant").alias(variant)] if variant else []), F.col("_draw").alias(draw), F.col("_key").alias(key),
                       F.col("_dist").alias("dist"), *cats)


def fewest_mismatches(attackers: DataFrame, pool: DataFrame, categorical: list[str], draw: str, variant: str | None = None) -> DataFrame:
    """(variant, draw, distance): fewest differing categories over the whole pool.

    For every subset of categories that may agree, the pool's distinct combinations are joined on that
    subset; the largest agreeing subset decides. Only distinct combinations move.
    """
    by = [variant] if variant else []
    text = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical]
    combos = pool.select(*by, *text).distinct()
    a = attackers.select(draw, *text)
    if variant:  # the numbers of the pools are few
        numbers = [r[0] for r in combos.select(variant).distinct().orderBy(variant).collect()]
        a = a.withColumn(variant, F.explode(F.array(*[F.lit(n).cast(combos.schema[variant].dataType) for n in numbers]))) if numbers else a.where("false").withColumn(variant, F.lit(0))
    best = a.select(*by, draw, F.lit(float(len(categorical))).alias("distance"))
    for mask in product((0, 1), repeat=len(categorical)):
        same = [c for c, m in zip(categorical, mask) if m]
        if same:
            hits = a.join(combos.select(*by, *same).distinct(), [*by, *same], "left_semi")
            best = best.unionByName(hits.select(*by, draw, F.lit(float(len(categorical) - len(same))).alias("distance")))
    return best.groupBy(*by, draw).agg(F.min("distance").alias("distance"))


def knn_mixed_distance(attackers: DataFrame, pool: DataFrame, numeric: list[str], categorical: list[str], draw: str, key: str, k: int = 5,
                       variant: str | None = None) -> DataFrame:
    """(variant, draw, distance): over the k numerically nearest pool rows, the least distance plus mismatches.

    Numeric columns are expected on a common scale already.
    """
    if not numeric:
        return fewest_mismatches(attackers, pool, categorical, draw, variant)
    near = nearest_rows(attackers, pool, numeric, categorical, draw, key, k, variant)
    mine = attackers.select(draw, *[F.col(c).cast("string").alias(f"a_{c}") for c in categorical])
    miss = sum(((~F.col(f"a_{c}").eqNullSafe(F.col(f"p_{c}"))).cast("double") for c in categorical), F.lit(0.0))
    by = [variant] if variant else []
    return near.join(mine, draw).groupBy(*by, draw).agg(F.min(F.col("dist") + miss).alias("distance"))


# ---- distance of every row to its nearest other row -------------------------------------------


def self_nn_distances_1d(df: DataFrame, column: str) -> DataFrame:
    """(distance, n): exact for one column, from the global order of its distinct values."""
    gaps = neighbour_gaps(df, column)
    return gaps.select(F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.col("gap")).alias("distance"), "n").where(
        F.col("distance").isNotNull())


class Cuts:
    """Cells of about equally many points: the space is halved at medians of alternating columns, told from a sample.

    A node is (column, value, left, right), points below the value going left; a leaf is (-1, 0, cell, cell).
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.cells = 0
        self._cut(sample, cells, 0)

    def _cut(self, x: np.ndarray, cells: int, column: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if cells > 1 and len(x) > 1:
            for j in [*range(column, x.shape[1]), *range(column)]:
                value = np.sort(x[:, j])[len(x) // 2]
                if value == x[:, j].min():  # half of the points share the least value: cut above it
                    above = x[:, j][x[:, j] > value]
                    if not len(above):
                        continue
                    value = above.min()
                below = x[:, j] < value
                right = cells // 2
                self.nodes[at] = (j, float(value), self._cut(x[below], cells - right, (j + 1) % x.shape[1]), self._cut(x[~below], right, (j + 1) % x.shape[1]))
                return at
        self.nodes[at] = (-1, 0.0, self.cells, self.cells)
        self.cells += 1
        return at

    def touched(self, x: np.ndarray, radius: np.ndarray):
        """(row, cell) of every cell that the ball around a row reaches; all rows go down a level together."""
        column, value, left, right = (np.array(c) for c in zip(*self.nodes))
        found, node, rows = [], np.zeros(len(x), np.int64), np.arange(len(x))
        while len(node):
            inner = column[node] >= 0
            found.append((rows[~inner], left[node[~inner]]))
            node, rows = node[inner], rows[inner]
            v, r = x[rows, column[node]], radius[rows] * (1 + 1e-9)
            low, high = v - r < value[node], v + r >= value[node]
            node, rows = np.concatenate([left[node[low]], right[node[high]]]), np.concatenate([rows[low], rows[high]])
        return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2


def nearest_within(x: np.ndarray) -> np.ndarray:
    """Distance of every one of some distinct points to the nearest other one."""
    tree, best = AttackerTree(x), np.full(len(x), np.inf)
    ends = np.array([(start, end) for _, _, start, end, left, _ in tree.nodes if left < 0 and end - start > 1], np.int64).reshape(-1, 2)
    for n in np.unique(ends[:, 1] - ends[:, 0]):  # leaves of one size together; larger ones hold equal points
        starts, step = ends[ends[:, 1] - ends[:, 0] == n, 0], max(1, MEETING // int(n * n))
        for i in range(0, len(starts), step):
            at = starts[i:i + step, None] + np.arange(n)
            sq = np.zeros((len(at), n, n))
            for j in range(x.shape[1]):
                diff = tree.points[at, j][:, :, None] - tree.points[at, j][:, None, :]
                sq += diff * diff
            gap = np.sqrt(sq)
            gap[:, np.arange(n), np.arange(n)] = np.inf
            best[at] = gap.min(axis=2)
    for start in range(0, len(x), CHUNK):
        row, at, dist = tree.improving(tree.points[start : start + CHUNK], best)
        other = row + start != at
        np.minimum.at(best, at[other], dist[other])
    out = np.empty(len(x))
    out[tree.order] = best
    return out


def self_nn_distances(df: DataFrame, columns: list[str], enough: float = 1.0, cell_points: int = 4096) -> DataFrame:
    """(distance, n): distance to the nearest other row; exact for the ``enough`` smallest share, and never too small for the rest.

    Equal rows collapse first (distance 0). Distinct points are dealt to cells of about ``cell_points`` by cuts at quantiles of
    alternating columns; inside a cell every point finds its nearest neighbour, which bounds the true distance. One exchange sends
    the points whose ball reaches over the border of their cell to the cells it touches; no ball needs to be larger than
    the bound that the wanted share lies under. The number of jobs does not depend on the columns or their values.
    """
    if len(columns) == 1:
        return self_nn_distances_1d(df, columns[0])
    spark = df.sparkSession
    kind = ", ".join(f"`{c}` double" for c in columns)
    counted = df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    points = materialize(counted.withColumn("_id", F.monotonically_increasing_id()), "points")
    n_points, n_rows, settled = points.agg(F.count(F.lit(1)), F.sum("_n"), F.sum(F.when(F.col("_n") > 1, F.col("_n")))).first()
    if not n_points:
        return spark.createDataFrame([], "distance double, n long")
    n_cells = min(MOST_CELLS, -(-n_points // cell_points))
    some = points.where(uniform(0, "cuts", "_id") < F.lit(SAMPLED * n_cells / n_points)) if n_cells > 1 else points.where("false")
    cuts = Cuts(some.select(*columns).toPandas().to_numpy(dtype=float).reshape(-1, len(columns)), n_cells)
    shared = spark.sparkContext.broadcast(cuts)

    def celled(batches):
        for pdf in batches:
            row, cell = shared.value.touched(pdf[columns].to_numpy(dtype=float), np.zeros(len(pdf)))
            pdf = pdf.iloc[row].copy()
            pdf["_cell"] = cell.astype(np.int32)
            yield pdf

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        found = nearest_within(pdf[columns].to_numpy(dtype=float))
        return pdf.assign(_bound=np.where(pdf["_n"] > 1, 0.0, found))

    home = f"{kind}, _n long, _id long, _cell int"
    bounded = materialize(points.mapInPandas(celled, home).groupBy("_cell").applyInPandas(inside, f"{home}, _bound double"), "bounded")
    if cuts.cells == 1:
        return bounded.select(F.col("_bound").alias("distance"), F.col("_n").alias("n"))
    # The wanted smallest distances lie under the bound at their place, as no bound is below its distance.
    place = min(1.0, (enough * (n_rows - 1) + 2) / n_rows)
    limit = exact_quantiles(bounded.withColumn("_bound", F.least(F.col("_bound"), F.lit(1e300))), ["_bound"], place, weight="_n").first()["q_value"] if enough < 1 else float("inf")

    def leaving(batches):
        for pdf in batches:
            radius = np.minimum(pdf["_bound"].to_numpy(), limit * (1 + 1e-9))
            row, cell = shared.value.touched(pdf[columns].to_numpy(dtype=float), radius)
            out = pdf.iloc[row][[*columns, "_id"]].copy()
            out["_cell"], out["_radius"] = cell.astype(np.int32), radius[row]
            yield out[cell != pdf["_cell"].to_numpy()[row]]

    def meet(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        tree, x = AttackerTree(guests[columns].to_numpy(dtype=float)), hosts[columns].to_numpy(dtype=float)
        best = guests["_radius"].to_numpy()[tree.order]
        for start in range(0, len(x), CHUNK):
            _, at, dist = tree.improving(x[start : start + CHUNK], best)
            np.minimum.at(best, at, dist)
        return pd.DataFrame({"_id": guests["_id"].to_numpy()[tree.order], "_met": best})

    guests = bounded.where("_n = 1").mapInPandas(leaving, f"{kind}, _id long, _cell int, _radius double")
    met = guests.groupBy("_cell").cogroup(bounded.select(*columns, "_cell").groupBy("_cell")).applyInPandas(meet, "_id long, _met double")
    nearer = met.where(F.col("_met") < float("inf")).groupBy("_id").agg(F.min("_met").alias("_met"))
    # A quantile reads the distances once for every pass over their digits, so guests meet hosts once and the result is written.
    return materialize(bounded.join(nearer, "_id", "left").select(_nearer("_bound", "_met", limit).alias("distance"), F.col("_n").alias("n")), "distances")


def _nearer(bound: str, met: str, limit: float) -> Column:
    """The smaller of both; a guest's own radius comes back where it met nobody, and says only that nothing is nearer."""
    return F.when(F.col(met).isNull(), F.col(bound)).when((F.col(met) >= F.lit(limit)) & (F.col(bound) > F.col(met)), F.col(bound)).otherwise(F.least(bound, met))


def self_nn_threshold(df: DataFrame, columns: list[str], q: float = 0.1) -> DataFrame:
    """(threshold,): the q-quantile of the nearest-other-row distances, 0.5 if there is none.

    Columns are expected on a common scale already; the quantile is exact.
    """
    if not columns or len(df.take(2)) < 2:
        return df.sparkSession.createDataFrame([(0.5,)], "threshold double")
    d = self_nn_distances(df, columns, enough=q)
    # A point that is alone in its cell and met nobody is infinitely far; a finite stand-in keeps the arithmetic clean.
    d = d.withColumn("distance", F.when(F.col("distance") == float("inf"), F.lit(1e300)).otherwise(F.col("distance")))
    return exact_quantiles(d, ["distance"], q, weight="n").select(F.col("q_value").alias("threshold"))


# ---- reports ----------------------------------------------------------------------------------


def _quasi(synthetic: DataFrame, reference: DataFrame, identifiers: list[str]) -> tuple[list[str], list[str]]:
    qi = [c for c in identifiers if c in synthetic.columns and c in reference.columns]
    if not qi:
        raise ValueError("no quasi-identifier is present in both tables")
    numeric = numeric_columns(reference, qi)
    numeric = [c for c in qi if c in numeric]
    return numeric, [c for c in qi if c not in numeric]


def noisy_pools(pool: DataFrame, numeric: list[str], others: list[str], levels: list[float], key: str, seed, scale_by: DataFrame) -> DataFrame:
    """The pool once for every noise level, scaled by ``scale_by``, told apart by ``_level``: one scan, its rows multiplied."""
    filled = {c: F.coalesce(number(pool, c), F.lit(0.0)) for c in numeric}
    own = pool.agg(*[F.stddev_pop(x).alias(c) for c, x in filled.items()])
    base = scale_by.withColumns({c: F.coalesce(number(scale_by, c), F.lit(0.0)) for c in numeric})
    moments = column_moments(base, numeric)
    cells = []
    for i, level in enumerate(levels):
        made = {c: x + laplace(uniform(seed, f"noise/{c}", key), F.lit(float(level)) * F.coalesce(F.nullif(own.select(c).scalar(), F.lit(0.0)), F.lit(1.0)))
                if level else x for c, x in filled.items()}
        cells.append(F.struct(F.lit(i).alias("_level"), *[
            ((x - moments.select(f"mean_{c}").scalar()) / F.coalesce(F.nullif(moments.select(f"std_{c}").scalar(), F.lit(0.0)), F.lit(1.0))).alias(c)
            for c, x in made.items()]))
    return pool.select(key, *others, F.explode(F.array(*cells)).alias("_n")).select(key, *others, "_n.*")


def noise_tradeoff(
    synthetic: DataFrame, reference: DataFrame, identifiers: list[str], levels: list[float], key: str,
    attackers: int = 1000, seed=0, scale: str = "reference",
) -> DataFrame:
    """(noise_level, threshold, rate): share of attackers closer than the threshold, per noise level.

    All levels are searched in one scan of the synthetic table. ``scale="own"`` rescales attackers, pool and reference each by
    their own moments.
    """
    numeric, cats = _quasi(synthetic, reference, identifiers)
    ref = reference.select(key, *numeric, *cats)
    pool = synthetic.select(key, *numeric, *cats)

    def scaled(df):
        return standardize(df, numeric, by=None if scale == "own" else ref) if numeric else df

    threshold = materialize(self_nn_threshold(scaled(ref), numeric), "threshold")
    att = materialize(scaled(sample_with_replacement(ref, attackers, key, seed)), "attackers")
    if not numeric:
        pools = pool.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(len(levels))])))
    elif scale == "own":
        noisy = [laplace_noise(pool, numeric, level, key, seed) if level else pool for level in levels]
        pools = reduce(DataFrame.unionByName, [standardize(p, numeric).withColumn("_level", F.lit(i)) for i, p in enumerate(noisy)])
    else:
        pools = noisy_pools(pool, numeric, cats, levels, key, seed, ref)
    t = threshold.select("threshold").scalar()
    rates = closer_rates(knn_mixed_distance(att, pools, numeric, cats, "draw", key, variant="_level"), t, "_level")
    named = ref.sparkSession.createDataFrame([(i, float(level)) for i, level in enumerate(levels)], "_level int, noise_level double")
    return named.join(rates, "_level", "left").select("noise_level", t.alias("threshold"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def closer_rates(distances: DataFrame, threshold: Column, variant: str) -> DataFrame:
    """(variant, rate): share of attackers with a smaller distance than the threshold."""
    return distances.groupBy(variant).agg(F.avg((F.col("distance") < threshold).cast("int")).alias("rate"))


def risk_facts(reference: DataFrame, identifiers: list[str], key: str, row: str, attackers: int, seed=0) -> dict:
    """What the tables of many candidates are compared with: the scaled attackers and the threshold, written once.

    ``row`` is the name that the key has in the candidates' tables.
    """
    numeric, cats = _quasi(reference, reference, identifiers)
    ref = reference.select(F.col(key).alias(row), *numeric, *cats)

    def scaled(df):
        return standardize(df, numeric, by=ref) if numeric else df

    return {"numeric": numeric, "categorical": cats, "row": row, "scaled": scaled,
            "threshold": materialize(self_nn_threshold(scaled(ref), numeric), "threshold"),
            "attackers": materialize(scaled(sample_with_replacement(ref, attackers, row, seed)), "attackers")}


def candidate_risk(samples: DataFrame, facts: dict, candidate: str, candidates: int) -> DataFrame:
    """(candidate, reid_rate) of all candidates' tables, searched in one scan against the same attackers."""
    numeric, cats = facts["numeric"], facts["categorical"]
    pools = facts["scaled"](samples.select(candidate, facts["row"], *numeric, *cats))
    distances = knn_mixed_distance(facts["attackers"], pools, numeric, cats, "draw", facts["row"], variant=candidate)
    rates = closer_rates(distances, facts["threshold"].select("threshold").scalar(), candidate)
    every = samples.sparkSession.range(candidates).select(F.col("id").cast("int").alias(candidate))
    return every.join(rates, candidate, "left").select(candidate, F.coalesce("rate", F.lit(0.0)).alias("reid_rate"))


def reid_risk(
    synthetic: DataFrame, reference: DataFrame, identifiers: list[str], key: str, attackers: int = 1000,
    noise_level: float = 0.01, seed=0, scale: str = "reference",
) -> DataFrame:
    """One row: threshold, rate before and after noise, their difference and the advice."""
    rates = noise_tradeoff(synthetic, reference, identifiers, [0.0, noise_level], key, attackers, seed, scale)
    tagged = rates.groupBy().agg(
        F.max("threshold").alias("threshold"),
        F.max(F.when(F.col("noise_level") == 0.0, F.col("rate"))).alias("rate"),
        F.max(F.when(F.col("noise_level") == F.lit(float(noise_level)), F.col("rate"))).alias("rate_after_noise"))
    high = F.col("rate") > 0.05
    return tagged.select(
        "threshold", "rate", "rate_after_noise", (F.col("rate") - F.col("rate_after_noise")).alias("delta"),
        F.when(high, F.lit("raise the noise level or generalise the riskiest identifiers"))
        .otherwise(F.lit("risk appears low")).alias("advice"))
