"""Scoring of a generated table against a reference, privacy, utility and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabloom.operators import privacy as PR, realism as R, sweep as T, utility as U
from tabloom.operators.coerce import standardize
from tabloom.operators.generate import generate
from tabloom.operators.order import key_index
from tabloom.plans.catalog.registry import average_rank, choice, query, rounded, table, u, z
from tabloom.plans.catalog.specs import PRIORITIES, SEED, SEGMENT_PROBS, SEGMENTS, STATUSES, SYNTHETIC_CUSTOMER
from tabloom.plans.catalog.tables import SYNTHETIC_SQL, synthetic_orders
from tabloom.sources.runtime import materialize
from tabloom.spec import TableSpec

NUM, CAT = ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]


def sides(spark, sf):
    """Generated and reference orders with a common key."""
    # As in a full run: generate once, write, then score the written table.
    gen = materialize(synthetic_orders(spark, sf).withColumnRenamed("_id", "o_orderkey"), "synthetic")
    return gen, table(spark, sf, "orders").select("o_orderkey", *NUM, *CAT)


def union(parts) -> str:
    return " UNION ALL ".join(parts)


GEN = f"g AS ({SYNTHETIC_SQL})"


def ks_sql(c: str, gen: str = "g", ref: str = "orders") -> str:
    """Both CDFs at every distinct value, the KS distance and the area between them."""
    return f"""
SELECT '{c}' AS field, CAST(max(tg) AS BIGINT) AS n_gen, CAST(max(tr) AS BIGINT) AS n_ref, max(abs(fg - fr)) AS ks_stat,
  coalesce(sum(abs(fg - fr) * (nv - v)), 0) AS emd FROM (
  SELECT v, sum(a) OVER w / sum(a) OVER () AS fg, sum(b) OVER w / sum(b) OVER () AS fr, sum(a) OVER () AS tg, sum(b) OVER () AS tr, lead(v) OVER (ORDER BY v) AS nv
  FROM (SELECT v, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM (
    SELECT CAST({c} AS DOUBLE) AS v, 1 AS a, 0 AS b FROM {gen} UNION ALL SELECT CAST({c} AS DOUBLE), 0, 1 FROM {ref}) GROUP BY v)
  WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


def kolmogorov_sql(d: str, n1: str, n2: str, terms: int = 60) -> str:
    x = f"({d} * sqrt(CAST({n1} AS DOUBLE) * {n2} / (CAST({n1} AS DOUBLE) + {n2})))"
    series = " + ".join(f"({2.0 * (-1) ** (k - 1)!r}e0 * exp({-2.0 * k * k!r}e0 * {x} * {x}))" for k in range(1, terms + 1))
    return f"(CASE WHEN {x} < 0.1 THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0, {series})) END)"


KS = f"WITH {GEN}, k AS ({union(ks_sql(c) for c in NUM)})"


@query("ks_two_sample", f"{KS} SELECT field, n_gen, n_ref, round(ks_stat, 6) AS ks_stat, round({kolmogorov_sql('ks_stat', 'n_gen', 'n_ref')}, 6) AS ks_pvalue FROM k")
def ks_two_sample(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.ks_two_sample(g, r, NUM))


@query("wasserstein_1d", f"{KS} SELECT field, round(emd, 4) AS emd FROM k")
def wasserstein_1d(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.wasserstein_1d(g, r, NUM), 4)


@query("align_pairs", f"WITH {GEN} SELECT o_orderkey, g.o_custkey AS gen_o_custkey, round(g.o_totalprice, 4) AS gen_o_totalprice, o.o_custkey AS ref_o_custkey, round(o.o_totalprice, 4) AS ref_o_totalprice FROM orders o JOIN g ON g._id = o_orderkey")
def align_pairs(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.align_pairs(g, r, NUM, "o_orderkey"), 4)


PAIR = "pr AS (SELECT g.o_custkey AS g0, o.o_custkey AS r0, g.o_totalprice AS g1, o.o_totalprice AS r1 FROM orders o JOIN g ON g._id = o_orderkey)"
RHO = "h AS (" + union(
    f"SELECT '{c}' AS field, corr(a, b) AS rho FROM (SELECT {average_rank(f'g{i}')} AS a, {average_rank(f'r{i}')} AS b FROM pr)" for i, c in enumerate(NUM)) + ")"
MOMENTS = "m AS (" + union(
    f"SELECT '{c}' AS field, (SELECT avg({c}) FROM g) AS mean_gen, avg({c}) AS mean_ref, stddev_pop({c}) AS std_ref FROM orders" for c in NUM) + ")"
NUMERIC = f"""{KS}, {PAIR}, {RHO}, {MOMENTS}, nm AS (SELECT field, mean_gen, mean_ref, std_ref, ks_stat, {kolmogorov_sql('ks_stat', 'n_gen', 'n_ref')} AS ks_pvalue, emd, rho,
  0.5e0 * ks_stat + 0.3e0 * least(1.0e0, emd / ((std_ref + 1e-9) * 3.0e0)) + 0.2e0 * (1 - abs(rho)) AS contribution,
  0.4e0 * (1 - ks_stat) + 0.3e0 * exp(-emd / ((std_ref + 1e-9) * 3.0e0)) + 0.3e0 * abs(rho) AS score FROM k JOIN h USING (field) JOIN m USING (field))"""


@query("realism_numeric", NUMERIC + """ SELECT field, round(mean_gen, 4) AS mean_gen, round(mean_ref, 4) AS mean_ref, round(std_ref, 4) AS std_ref, round(ks_stat, 6) AS ks_stat,
  round(ks_pvalue, 6) AS ks_pvalue, round(emd, 4) AS emd, round(rho, 6) AS rho, round(contribution, 6) AS contribution, round(score, 6) AS score FROM nm""")
def realism_numeric(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.realism_numeric(g, r, NUM, "o_orderkey"), 6, mean_gen=4, mean_ref=4, std_ref=4, emd=4)


def topk_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS field, value, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, value LIMIT 10)"""


@query("topk_shares", f"WITH {GEN}, s AS ({union(topk_sql('g', c) for c in [*CAT, 'o_custkey'])}) SELECT field, value, n, round(share, 6) AS share FROM s")
def topk_shares(spark, sf):
    return rounded(R.topk_shares(sides(spark, sf)[0], [*CAT, "o_custkey"]))


THREE = [*CAT, "o_custkey"]
PQ = f"""tg AS ({union(topk_sql('g', c) for c in THREE)}), tr AS ({union(topk_sql('orders', c) for c in THREE)}),
pq AS (SELECT field, value, coalesce(tg.share, 0) AS p, coalesce(tr.share, 0) AS q FROM tg FULL JOIN tr USING (field, value)),
sm AS (SELECT field, p, q, (p + 1e-12) / sum(p + 1e-12) OVER f AS a, (q + 1e-12) / sum(q + 1e-12) OVER f AS b FROM pq WINDOW f AS (PARTITION BY field)),
js AS (SELECT field, count_if(p > 0 AND q > 0) / CAST(count(*) AS DOUBLE) AS top_k_overlap,
  sum(0.5e0 * (a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2)))) AS js_divergence FROM sm GROUP BY field),
ob AS (SELECT field, round_even(p * 100000, 0) AS o1, round_even(q * 100000, 0) AS o2 FROM pq),
ex AS (SELECT field, o1, o2, sum(o1) OVER f * (o1 + o2) / (sum(o1) OVER f + sum(o2) OVER f) AS e1, sum(o2) OVER f * (o1 + o2) / (sum(o1) OVER f + sum(o2) OVER f) AS e2
  FROM ob WINDOW f AS (PARTITION BY field)),
x2 AS (SELECT field, sum((o1 - e1) * (o1 - e1) / e1 + (o2 - e2) * (o2 - e2) / e2) AS chi2, CAST(count(*) - 1 AS INTEGER) AS dof FROM ex GROUP BY field)"""


@query("topk_overlap_js", f"WITH {GEN}, {PQ} SELECT field, round(top_k_overlap, 6) AS top_k_overlap, round(js_divergence, 6) AS js_divergence FROM js")
def topk_overlap_js(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.topk_overlap_js(R.topk_pairs(g, r, THREE)))


@query("contingency_chi2", f"WITH {GEN}, {PQ} SELECT field, round(chi2, 4) AS chi2, dof FROM x2")
def contingency_chi2(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.contingency_chi2(R.topk_pairs(g, r, THREE)).drop("pvalue"), 4)


# Two and four degrees of freedom have a closed upper tail.
CATEGORICAL = f"""{PQ}, cm AS (SELECT field, top_k_overlap, js_divergence, CASE dof WHEN 2 THEN exp(-chi2 / 2) ELSE exp(-chi2 / 2) * (1 + chi2 / 2) END AS chi2_pvalue
  FROM js JOIN x2 USING (field) WHERE field <> 'o_custkey'),
cs AS (SELECT *, 0.5e0 * js_divergence + 0.3e0 * (1 - top_k_overlap) + 0.2e0 * (1 - chi2_pvalue) AS contribution,
  0.5e0 * (1 - least(1.0e0, js_divergence)) + 0.3e0 * top_k_overlap + 0.2e0 * chi2_pvalue AS score FROM cm)"""


@query("realism_categorical", f"""WITH {GEN}, {CATEGORICAL}
SELECT field, round(top_k_overlap, 6) AS top_k_overlap, round(js_divergence, 6) AS js_divergence, round(chi2_pvalue, 6) AS chi2_pvalue, round(contribution, 6) AS contribution, round(score, 6) AS score FROM cs""")
def realism_categorical(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.realism_categorical(g, r, CAT))


BOTH = f"{NUMERIC}, {CATEGORICAL}"


@query("realism_composite", f"""{BOTH}, t AS (SELECT (SELECT avg(score) FROM nm) AS a, (SELECT avg(score) FROM cs) AS b)
SELECT round(a, 6) AS numeric_score, round(b, 6) AS categorical_score, round(least(1.0e0, greatest(0.0e0, 0.6e0 * a + 0.4e0 * b)) * 100.0e0, 4) AS composite_score FROM t""")
def realism_composite(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.realism_composite(g, r, NUM, CAT, "o_orderkey"), 6, composite_score=4)


@query("feature_ranking", f"""{BOTH} SELECT field, kind, round(contribution, 6) AS contribution FROM (
  SELECT field, 'numeric' AS kind, contribution FROM nm UNION ALL SELECT field, 'categorical', contribution FROM cs) ORDER BY contribution DESC, field LIMIT 10""")
def feature_ranking(spark, sf):
    g, r = sides(spark, sf)
    return rounded(R.feature_ranking(g, r, NUM, CAT, "o_orderkey"))


# ---- privacy: synthetic customers against the customer table

QI = ["c_acctbal", "c_nationkey", "c_mktsegment"]
NQI = ["c_acctbal", "c_nationkey"]
ATTACKERS = 300
LEVEL = 0.05


def people(spark, sf):
    ref = table(spark, sf, "customer").select("c_custkey", *QI)
    syn = generate(spark, SYNTHETIC_CUSTOMER, SEED, ids=ref.select(F.col("c_custkey").alias("_id"))).withColumnRenamed("_id", "c_custkey")
    return syn, ref


PEOPLE = f"""sy AS (SELECT c_custkey, -900.0e0 + 10400.0e0 * {u(SEED, 'c_acctbal', 'c_custkey')} AS c_acctbal, CAST(floor({u(SEED, 'c_nationkey', 'c_custkey')} * 25.0e0) AS BIGINT) AS c_nationkey,
  {choice(SEGMENTS, SEGMENT_PROBS, u(SEED, 'c_mktsegment', 'c_custkey'))} AS c_mktsegment FROM customer),
mo AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
rs AS (SELECT c_custkey, (c_acctbal - m0) / s0 AS x, (c_nationkey - m1) / s1 AS y, c_mktsegment AS seg FROM customer, mo),
ix AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM rs),
dr AS (SELECT i AS draw, CAST(floor({u(0, 'attackers', 'i')} * (SELECT count(*) FROM customer)) AS BIGINT) AS pick FROM (SELECT unnest(range({ATTACKERS})) AS i)),
att AS (SELECT draw, x, y, seg FROM dr JOIN ix ON pick = i)"""


def risk_sql(name: str, level: float) -> str:
    """Least distance plus mismatch over the five nearest synthetic rows, per attacker."""
    def noisy(c):
        draw = f"({u(0, f'noise/{c}', 'c_custkey')} + {2.0 ** -53!r} - 0.5e0)"
        return f"(CAST({c} AS DOUBLE) - ({level!r}e0 * (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM sy)) * sign({draw}) * ln(1.0e0 - 2.0e0 * abs({draw})))" if level else c

    return f"""{name}p AS (SELECT c_custkey, ({noisy('c_acctbal')} - m0) / s0 AS x, ({noisy('c_nationkey')} - m1) / s1 AS y, c_mktsegment AS seg FROM sy, mo),
{name}d AS (SELECT draw, min(d + miss) AS distance FROM (
  SELECT draw, d, miss, row_number() OVER (PARTITION BY draw ORDER BY d, c_custkey) AS k FROM (
    SELECT a.draw, p.c_custkey, sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) AS d, CAST(a.seg <> p.seg AS DOUBLE) AS miss FROM att a, {name}p p)) WHERE k <= 5 GROUP BY draw)"""


THRESHOLD = """th AS (SELECT quantile_cont(d, 0.1) AS t FROM (
  SELECT a.c_custkey, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM rs a JOIN rs b ON a.c_custkey <> b.c_custkey GROUP BY 1))"""


@query("sample_with_replacement", f"WITH {PEOPLE} SELECT draw, pick AS row_index, c_custkey FROM dr JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) ON pick = i")
def sample_with_replacement(spark, sf):
    ref = table(spark, sf, "customer").select("c_custkey")
    picked = PR.sample_with_replacement(ref, ATTACKERS, "c_custkey")
    return picked.join(key_index(ref, "c_custkey", "row_index"), "c_custkey").select("draw", "row_index", "c_custkey")


@query("laplace_noise", f"""
WITH {PEOPLE}, {risk_sql('a', LEVEL)} SELECT c_custkey, round(x * (SELECT s0 FROM mo) + (SELECT m0 FROM mo), 4) AS c_acctbal FROM ap""")
def laplace_noise(spark, sf):
    syn, _ = people(spark, sf)
    return rounded(PR.laplace_noise(syn.select("c_custkey", "c_acctbal"), ["c_acctbal"], LEVEL, "c_custkey"), 4)


@query("knn_mixed_distance", f"WITH {PEOPLE}, {risk_sql('a', 0.0)} SELECT draw, round(distance, 6) AS distance FROM ad")
def knn_mixed_distance(spark, sf):
    syn, ref = people(spark, sf)
    att = standardize(PR.sample_with_replacement(ref, ATTACKERS, "c_custkey"), NQI, by=ref)
    return rounded(PR.knn_mixed_distance(att, standardize(syn, NQI, by=ref), NQI, ["c_mktsegment"], "draw", "c_custkey"))


@query("self_nn_threshold", f"WITH {PEOPLE}, {THRESHOLD} SELECT round(t, 6) AS threshold FROM th")
def self_nn_threshold(spark, sf):
    _, ref = people(spark, sf)
    return rounded(PR.self_nn_threshold(standardize(ref, NQI), NQI))


RATE = "(SELECT avg(CASE WHEN distance < (SELECT t FROM th) THEN 1.0e0 ELSE 0.0e0 END) FROM {})"


@query("reid_risk", f"""WITH {PEOPLE}, {THRESHOLD}, {risk_sql('a', 0.0)}, {risk_sql('b', LEVEL)}, r AS (SELECT {RATE.format('ad')} AS rate, {RATE.format('bd')} AS after)
SELECT round(t, 6) AS threshold, round(rate, 6) AS rate, round(after, 6) AS rate_after_noise, round(rate - after, 6) AS delta,
  CASE WHEN rate > 0.05 THEN 'raise the noise level or generalise the riskiest identifiers' ELSE 'risk appears low' END AS advice FROM r, th""")
def reid_risk(spark, sf):
    syn, ref = people(spark, sf)
    return rounded(PR.reid_risk(syn, ref, QI, "c_custkey", ATTACKERS, LEVEL))


@query("noise_tradeoff", f"""WITH {PEOPLE}, {THRESHOLD}, {risk_sql('a', 0.0)}, {risk_sql('b', LEVEL)}, {risk_sql('c', 2 * LEVEL)}
SELECT 0.0e0 AS noise_level, round(t, 6) AS threshold, round({RATE.format('ad')}, 6) AS rate FROM th
UNION ALL SELECT {LEVEL!r}e0, round(t, 6), round({RATE.format('bd')}, 6) FROM th
UNION ALL SELECT {2 * LEVEL!r}e0, round(t, 6), round({RATE.format('cd')}, 6) FROM th""")
def noise_tradeoff(spark, sf):
    syn, ref = people(spark, sf)
    return rounded(PR.noise_tradeoff(syn, ref, QI, [0.0, LEVEL, 2 * LEVEL], "c_custkey", ATTACKERS))


# ---- utility


def line_sides(spark, sf):
    """Reference lines with a key, and a noisy copy of them as the synthetic side."""
    ref = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    ref = ref.withColumn("big", (F.col("o_totalprice") > 250000).cast("int"))
    return PR.laplace_noise(ref, ["o_totalprice"], 0.05, "o_orderkey"), ref


@query("train_synth_test_real")
def train_synth_test_real(spark, sf):
    syn, ref = line_sides(spark, sf)
    return rounded(U.train_synth_test_real(syn, ref, "big", "o_orderkey", trees=20))


@query("boosted_utility", f"""
WITH t AS (SELECT o_orderkey, CAST(o_totalprice > 250000 AS INTEGER) AS big, {u(0, 'split', 'o_orderkey')} AS x FROM orders),
s AS (SELECT big, CAST(x < 0.2e0 OR x = (SELECT min(x) FROM t) AS INTEGER) AS is_test FROM t)
SELECT CAST(big AS DOUBLE) AS y, is_test, count(*) AS n, 1 AS in_bounds, 1 AS nearly_all_right FROM s GROUP BY big, is_test""")
def boosted_utility(spark, sf):
    """Rows per true class and part of the reference; the shares of right predictions lie in their bounds and near one."""
    syn, ref = line_sides(spark, sf)
    scored, _ = U.predictions(syn, ref, "big", "o_orderkey", learner="boosted")
    right = F.avg((F.col("y") == F.col("prediction")).cast("double"))
    return scored.groupBy("y", "is_test").agg(F.count(F.lit(1)).alias("n"), right.between(0.0, 1.0).cast("int").alias("in_bounds"),
                                              (right > 0.9).cast("int").alias("nearly_all_right"))


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    syn, ref = line_sides(spark, sf)
    scored, _ = U.predictions(syn, ref, "big", "o_orderkey", trees=20)
    return U.confusion_matrix(scored.where("is_test = 1"))


@query("hash_split", f"""WITH t AS (SELECT doc_id, {u(0, 'split', 'doc_id')} AS x FROM labels)
SELECT doc_id, CAST(x < 0.2e0 OR x = (SELECT min(x) FROM t) AS INTEGER) AS is_test FROM t""")
def hash_split(spark, sf):
    return U.hash_split(table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("onehot_top20", """
WITH t AS (SELECT p_brand AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 20), k AS (SELECT v, row_number() OVER () - 1 AS i FROM t)
SELECT p_partkey, CAST(count(k.v) AS DOUBLE) AS ones, count(*) AS "rows" FROM part LEFT JOIN k ON p_brand = k.v GROUP BY p_partkey""")
def onehot_top20(spark, sf):
    df, fitted = U.onehot_top(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"])
    marks = [f"p_brand__{i}" for i in range(len(fitted["p_brand"]))]
    return df.groupBy("p_partkey").agg(F.sum(sum((F.col(m) for m in marks), F.lit(0.0))).alias("ones"), F.count(F.lit(1)).alias("rows"))


EXPLAIN = ["value", "user_id", "hour"]


def labelled_events(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label"), "value", "user_id", F.hour("ts").alias("hour"),
        F.dayofweek("ts").cast("string").alias("weekday"), F.get_json_object("props", "$.k").alias("k"))


@query("explain_numeric", f"""
WITH t AS (SELECT CAST(event_type = 'error' AS INTEGER) AS label, value, user_id, hour(ts) AS hour FROM events),
r AS (SELECT {average_rank('label')} AS y, {', '.join(f'{average_rank(c)} AS r{i}' for i, c in enumerate(EXPLAIN))} FROM t),
c AS ({union(f"SELECT '{c}' AS field, corr(r{i}, y) AS rho FROM r" for i, c in enumerate(EXPLAIN))})
SELECT field, round(rho, 6) AS rho FROM c ORDER BY abs(c.rho) DESC, field LIMIT 3""")
def explain_numeric(spark, sf):
    return rounded(U.explain_numeric(labelled_events(spark, sf), "label", EXPLAIN))


@query("explain_lift", """
WITH t AS (SELECT CAST(event_type = 'error' AS INTEGER) AS label, CAST(dayofweek(ts) + 1 AS VARCHAR) AS weekday, json_extract_string(props, '$.k') AS k FROM events),
g AS (SELECT 'weekday' AS field, weekday AS value, avg(label) AS p FROM t GROUP BY 2 UNION ALL SELECT 'k', k, avg(label) FROM t WHERE k IS NOT NULL GROUP BY 2)
SELECT field, value, round(p / (SELECT avg(label) FROM t), 6) AS lift FROM g ORDER BY p / (SELECT avg(label) FROM t) DESC, field, value LIMIT 3""")
def explain_lift(spark, sf):
    return rounded(U.explain_lift(labelled_events(spark, sf), "label", ["weekday", "k"]))


@query("objective_score", """
WITH t AS (SELECT p_partkey, 40.0e0 + p_size AS realism, CASE WHEN p_partkey % 2 = 0 THEN p_size / 50.0e0 ELSE -p_size / 4.0e0 END AS s, CAST(p_partkey % 2 = 0 AS INTEGER) AS k, p_size / 100.0e0 AS r FROM part),
v AS (SELECT *, CASE WHEN k = 1 THEN greatest(0, least(100, 100.0e0 * s)) ELSE greatest(0, least(100, 100.0e0 * (1 + s / 10.0e0))) END AS a, greatest(0, least(100, 100.0e0 * r)) AS b FROM t)
SELECT p_partkey, round(a, 6) AS utility_score, round(b, 6) AS risk_score, round(0.45e0 * realism + 0.35e0 * a - 0.20e0 * b, 6) AS objective FROM v""")
def objective_score(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") + F.lit(40.0)).alias("realism"),
        F.when(even, F.col("p_size") / F.lit(50.0)).otherwise(-F.col("p_size") / F.lit(4.0)).alias("real_test_score"),
        even.cast("int").alias("is_classification"), (F.col("p_size") / F.lit(100.0)).alias("reid_rate"))
    return rounded(U.objective_score(rows).select("p_partkey", "utility_score", "risk_score", "objective"))


# ---- search


def learned_parameters(spark, sf):
    """(field, param, idx, value) of the order specification, from the table."""
    o = table(spark, sf, "orders")
    price = o.agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))
    nums = price.select(F.explode(F.array(*[
        F.struct(F.lit("o_totalprice").alias("field"), F.lit(p).alias("param"), F.lit(0).alias("idx"), F.col(p).alias("value")) for p in ("mean", "std")])).alias("c")).select("c.*")
    n = o.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    shares = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    position = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")).cast("int") - 1
    return nums.unionByName(shares.select(F.lit("o_orderpriority").alias("field"), F.lit("probs").alias("param"), position.alias("idx"), (F.col("k") / n).alias("value")))


CANDIDATES = 5
MOVE = f"(0.2e0 * {u(SEED, 'perturb', 'candidate', 'field', 'param', 'idx')} - 0.1e0)"


@query("perturb_specs", f"""
WITH b AS (SELECT 'o_totalprice' AS field, 'mean' AS param, 0 AS idx, avg(o_totalprice) AS value FROM orders
  UNION ALL SELECT 'o_totalprice', 'std', 0, stddev_pop(o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'probs', list_position({PRIORITIES!r}, o_orderpriority) - 1, count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) FROM orders GROUP BY o_orderpriority),
c AS (SELECT candidate, field, param, idx, value FROM b, (SELECT unnest(range({CANDIDATES + 1})) AS candidate)),
m AS (SELECT candidate, field, param, idx, CASE WHEN candidate = 0 THEN value WHEN param = 'probs' THEN greatest(1e-12, value + {MOVE})
  WHEN param = 'std' THEN greatest(1e-9, value * (1.0e0 + {MOVE})) ELSE value * (1.0e0 + {MOVE}) END AS value FROM c)
SELECT CAST(candidate AS INTEGER) AS candidate, field, param, CAST(idx AS INTEGER) AS idx,
  round(CASE WHEN param = 'probs' THEN value / sum(value) OVER (PARTITION BY candidate, field, param) ELSE value END, 4) AS value FROM m""")
def perturb_specs(spark, sf):
    return rounded(T.perturb_specs(learned_parameters(spark, sf), CANDIDATES, 0.10, SEED), 4)


SEARCH = TableSpec.from_dict({"fields": [
    {"name": "o_totalprice", "type": "float", "distribution": "normal", "mean": 200000, "std": 100000},
    {"name": "o_custkey", "type": "int", "distribution": "normal", "mean": 700, "std": 500},
    {"name": "o_orderstatus", "type": "category", "categories": STATUSES, "probs": [0.6, 0.2, 0.2]}]})


@query("score_candidates")
def score_candidates(spark, sf):
    ref = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    _, history = T.search(SEARCH, ref, rounds=2, batch=3, budget=1000, seed=SEED, key="o_orderkey", target="o_orderstatus")
    return rounded(history, 4)


BASE = TableSpec.from_dict({"fields": [
    {"name": "c_acctbal", "type": "float", "distribution": "normal", "mean": 4500, "std": 3200},
    {"name": "c_nationkey", "type": "int", "distribution": "normal", "mean": 12, "std": 7},
    {"name": "c_mktsegment", "type": "category", "categories": SEGMENTS, "probs": SEGMENT_PROBS}]})
BUDGET = 400
BASE_SQL = f"""g AS (SELECT i AS c_custkey, 4500.0e0 + 3200.0e0 * {z(SEED, 'c_acctbal', 'i')} AS c_acctbal,
  CAST(round_even(12.0e0 + 7.0e0 * {z(SEED, 'c_nationkey', 'i')}, 0) AS BIGINT) AS c_nationkey,
  {choice(SEGMENTS, SEGMENT_PROBS, u(SEED, 'c_mktsegment', 'i'))} AS c_mktsegment FROM (SELECT unnest(range({BUDGET})) AS i)),
k AS ({ks_sql('c_acctbal', 'g', 'customer')} UNION ALL {ks_sql('c_nationkey', 'g', 'customer')}),
sd AS (SELECT 'c_acctbal' AS field, stddev_pop(c_acctbal) AS s FROM customer UNION ALL SELECT 'c_nationkey', stddev_pop(c_nationkey) FROM customer),
num AS (SELECT avg((0.4e0 * (1 - ks_stat) + 0.3e0 * exp(-emd / ((s + 1e-9) * 3.0e0))) / 0.7e0) AS score FROM k JOIN sd USING (field)),
tg AS ({topk_sql('g', 'c_mktsegment')}), tr AS ({topk_sql('customer', 'c_mktsegment')}),
pq AS (SELECT coalesce(tg.share, 0) AS p, coalesce(tr.share, 0) AS q FROM tg FULL JOIN tr USING (field, value)),
sm AS (SELECT p, q, (p + 1e-12) / sum(p + 1e-12) OVER () AS a, (q + 1e-12) / sum(q + 1e-12) OVER () AS b FROM pq),
js AS (SELECT count_if(p > 0 AND q > 0) / CAST(count(*) AS DOUBLE) AS o, sum(0.5e0 * (a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2)))) AS j FROM sm),
ob AS (SELECT round_even(p * 100000, 0) AS o1, round_even(q * 100000, 0) AS o2 FROM pq),
ex AS (SELECT o1, o2, sum(o1) OVER () * (o1 + o2) / (sum(o1) OVER () + sum(o2) OVER ()) AS e1, sum(o2) OVER () * (o1 + o2) / (sum(o1) OVER () + sum(o2) OVER ()) AS e2 FROM ob),
x2 AS (SELECT sum((o1 - e1) * (o1 - e1) / e1 + (o2 - e2) * (o2 - e2) / e2) AS chi2 FROM ex),
re AS (SELECT 100.0e0 * (0.6e0 * (SELECT score FROM num) + 0.4e0 * (0.5e0 * (1 - least(1.0e0, j)) + 0.3e0 * o + 0.2e0 * exp(-chi2 / 2) * (1 + chi2 / 2))) AS realism FROM js, x2),
mo AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
rs AS (SELECT c_custkey, (c_acctbal - m0) / s0 AS x, (c_nationkey - m1) / s1 AS y, c_mktsegment AS seg, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer, mo),
po AS (SELECT c_custkey, (c_acctbal - m0) / s0 AS x, (c_nationkey - m1) / s1 AS y, c_mktsegment AS seg FROM g, mo),
n AS (SELECT count(*) AS n FROM customer),
att AS (SELECT draw, x, y, seg FROM (SELECT i AS draw, CAST(floor({u(SEED, 'attackers', 'i')} * n) AS BIGINT) AS pick
  FROM (SELECT unnest(range({BUDGET})) AS i), n WHERE i < n) JOIN rs ON pick = i),
di AS (SELECT draw, min(d + miss) AS distance FROM (SELECT draw, d, miss, row_number() OVER (PARTITION BY draw ORDER BY d, c_custkey) AS k FROM (
  SELECT a.draw, p.c_custkey, sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) AS d, CAST(a.seg <> p.seg AS DOUBLE) AS miss FROM att a, po p)) WHERE k <= 5 GROUP BY draw),
{THRESHOLD},
ri AS (SELECT 100.0e0 * avg(CASE WHEN distance < t THEN 1.0e0 ELSE 0.0e0 END) AS risk FROM di, th)"""


@query("score_base", f"""WITH {BASE_SQL}, o AS (SELECT realism, 50.0e0 AS utility, risk FROM re, ri)
SELECT 'balanced' AS goal, round(0.45e0 * realism + 0.35e0 * utility - 0.20e0 * risk, 4) AS objective, round(realism, 4) AS realism, utility, round(risk, 4) AS privacy_risk FROM o
UNION ALL SELECT 'privacy', round(100.0e0 - risk, 4), round(realism, 4), utility, round(risk, 4) FROM o
UNION ALL SELECT 'realism', round(realism, 4), round(realism, 4), utility, round(risk, 4) FROM o
UNION ALL SELECT 'utility', utility, round(realism, 4), utility, round(risk, 4) FROM o""")
def score_base(spark, sf):
    """The unchanged specification by all four objectives; without a target the utility is neutral."""
    ref = table(spark, sf, "customer").select("c_custkey", *QI)
    samples = materialize(T.candidate_tables(spark, [BASE], BUDGET, SEED), "samples")
    goal = T.Objective(BASE, ref, key="c_custkey", attackers=min(BUDGET, ref.count()), seed=SEED)
    rows = materialize(goal.measured(samples, 1), "measured")
    made = [U.objective_score(rows, name).withColumn("goal", F.lit(name)) for name in ("balanced", "privacy", "realism", "utility")]
    return rounded(reduce(DataFrame.unionByName, made).select(
        "goal", "objective", "realism", F.col("utility_score").alias("utility"), F.col("risk_score").alias("privacy_risk")), 4)


@query("search_utility")
def search_utility(spark, sf):
    """The other search: means, spreads and bounds move, and the bare held-out score of the models decides."""
    ref = table(spark, sf, "customer").select("c_custkey", *QI).withColumn("rich", (F.col("c_acctbal") > 4500).cast("int"))
    spec = TableSpec.from_dict({"fields": [
        {"name": "c_acctbal", "type": "float", "min": -900, "max": 9900}, {"name": "c_mktsegment", "type": "category", "categories": SEGMENTS},
        {"name": "rich", "type": "bool"}]})
    _, history = T.search(spec, ref, rounds=1, batch=3, budget=500, seed=SEED, key="c_custkey", target="rich", objective="test_score", bounds=True)
    return rounded(history, 4)


@query("select_best", """
WITH t AS (SELECT CAST(c_nationkey AS INTEGER) AS candidate, round(avg(c_acctbal), 2) AS objective FROM customer GROUP BY 1)
SELECT candidate, objective FROM t ORDER BY objective DESC, candidate LIMIT 1""")
def select_best(spark, sf):
    scores = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("candidate")).agg(F.round(F.avg("c_acctbal"), 2).alias("objective"))
    return T.select_best(scores)
