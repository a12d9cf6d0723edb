"""Learned priors, lookups, copulas and learned generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.rng import uniform
from tabloom.operators import learn as L, profile as P, relational as R
from tabloom.operators.order import run_lengths
from tabloom.plans.catalog.registry import average_rank, query, rounded, table, u, wide, z
from tabloom.plans.catalog.specs import LINE_LEARNING, ORDER_LEARNING, SEED
from tabloom.sources.runtime import materialize, scratch_path


def line_ids(spark, sf):
    return wide(spark, sf, "orders", "o_orderkey", "o_orderkey").toDF("_id")


@query("lookup_conditional_numeric", f"""
WITH s AS (SELECT o_orderpriority AS v, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
g AS (SELECT avg(o_totalprice) AS gm, stddev_pop(o_totalprice) AS gs FROM orders)
SELECT o_orderkey AS _id, o_orderpriority, round(least(400000.0e0, greatest(1000.0e0, coalesce(m, gm) + greatest(1e-9, coalesce(s, gs)) * {z(SEED, 'price', 'o_orderkey')})), 2) AS price
FROM orders LEFT JOIN s ON v = o_orderpriority, g""")
def lookup_conditional_numeric(spark, sf):
    o = table(spark, sf, "orders")
    stats = P.conditional_numeric(o.where("o_orderpriority <> '5-LOW'"), [("o_orderpriority", "o_totalprice")])
    g = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    rows = o.select(F.col("o_orderkey").alias("_id"), "o_orderpriority")
    fallback = (g.select("m").scalar(), g.select("s").scalar())
    return rounded(R.lookup_conditional_numeric(rows, "o_orderpriority", stats, fallback, "price", SEED, 1000.0, 400000.0), 2)


@query("lookup_cpt_sample", f"""
WITH c AS (SELECT DISTINCT l_linestatus AS cv FROM lineitem), pn AS (SELECT l_returnflag AS pv, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
pr AS (SELECT pv, cv, (coalesce((SELECT count(*) FROM lineitem WHERE l_returnflag = pv AND l_linestatus = cv), 0) + 1.0e0) / (n + (SELECT count(*) FROM c)) AS p FROM pn, c),
cu AS (SELECT pv, cv, CASE WHEN row_number() OVER (PARTITION BY pv ORDER BY cv DESC) = 1 THEN 1.0e0 ELSE sum(p) OVER (PARTITION BY pv ORDER BY cv ROWS UNBOUNDED PRECEDING) END AS cum FROM pr),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, {u(SEED, 'status', 'l_orderkey')} AS x FROM lineitem)
SELECT l_orderkey AS _id, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  coalesce((SELECT min(cv) FROM cu WHERE pv = l_returnflag AND cum > x), list_extract((SELECT list(cv ORDER BY cv) FROM c), CAST(floor(x * (SELECT count(*) FROM c)) AS INTEGER) + 1)) AS status FROM r""")
def lookup_cpt_sample(spark, sf):
    li = table(spark, sf, "lineitem")
    cpt = P.conditional_category_table(li, "l_returnflag", "l_linestatus").where("parent_value <> 'R'")
    rows = li.select(F.col("l_orderkey").alias("_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return R.lookup_cpt_sample(rows, "l_returnflag", cpt, "status", SEED)


@query("empirical_quantile_map", f"""
WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders),
d AS (SELECT event_id, CAST(floor({u(SEED, 'draw', 'event_id')} * ((SELECT count(*) FROM orders) - 1)) AS BIGINT) AS i FROM events)
SELECT event_id, v FROM d JOIN s USING (i)""")
def empirical_quantile_map(spark, sf):
    draws = table(spark, sf, "events").select("event_id", uniform(SEED, "draw", "event_id").alias("draw"))
    runs = materialize(run_lengths(table(spark, sf, "orders"), ["o_totalprice"]), "runs")
    return R.empirical_quantile_map(draws, "draw", runs, "v").select("event_id", "v")


# The reordered columns keep their values, whatever the ranks: their sums and ranges must not move.
@query("rank_copula_reorder", """
SELECT 'l_quantity' AS field, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_quantity) AS values FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), round(sum(l_extendedprice), 2), min(l_extendedprice), max(l_extendedprice), count(DISTINCT l_extendedprice) FROM lineitem""")
def rank_copula_reorder(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_tax", "l_discount")
    key = F.xxhash64(*li.columns)
    rows = li.select(key.alias("_id"), "l_quantity", "l_extendedprice")
    # The reference couples quantity and price, so the reordering has something to do.
    reference = li.select("l_quantity", (F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("l_extendedprice"))
    out = R.rank_copula_reorder(reference, rows, ["l_quantity", "l_extendedprice"])
    cols = ["l_quantity", "l_extendedprice"]
    stats = {"n": F.count, "total": lambda c: F.round(F.sum(c), 2), "low": F.min, "high": F.max, "values": F.count_distinct}
    one = out.agg(*[fn(c).alias(f"{c}|{k}") for c in cols for k, fn in stats.items()])
    return P.stack_rows(one, [{"field": F.lit(c), **{k: F.col(f"`{c}|{k}`") for k in stats}} for c in cols])


@query("copula_sample")
def copula_sample(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    li = table(spark, sf, "lineitem")
    covariance = R.square(P.gaussian_covariance(li, cols), cols)
    quantiles = materialize(run_lengths(li, cols), "quantiles")
    return R.copula_sample(line_ids(spark, sf), covariance, quantiles, cols, SEED)


PRIORS_SQL = f"""
WITH sp AS (SELECT {average_rank('o_totalprice')} AS a, {average_rank('o_custkey')} AS b FROM orders),
st AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1), pr AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT 'category' AS prior, 'o_orderstatus' AS subject, v AS item, round((n + 1.0e0) / sum(n + 1.0e0) OVER (), 6) AS value FROM st
UNION ALL SELECT 'category', 'o_orderpriority', v, round((n + 1.0e0) / sum(n + 1.0e0) OVER (), 6) FROM pr
UNION ALL SELECT 'numeric', 'o_totalprice', 'mean', round(avg(o_totalprice), 4) FROM orders
UNION ALL SELECT 'numeric', 'o_custkey', 'mean', round(avg(o_custkey), 4) FROM orders
UNION ALL SELECT 'conditional_numeric', 'o_totalprice', o_orderpriority, round(avg(o_totalprice), 4) FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'conditional_category', 'o_orderpriority', s.v || '>' || p.v,
  round(((SELECT count(*) FROM orders WHERE o_orderstatus = s.v AND o_orderpriority = p.v) + 1.0e0) / (s.n + (SELECT count(*) FROM pr)), 6) FROM st s, pr p
UNION ALL SELECT 'spearman', 'o_totalprice', 'o_custkey', round(corr(a, b), 6) FROM sp
UNION ALL SELECT 'quantiles', 'o_totalprice', 'distinct', CAST(count(DISTINCT o_totalprice) AS DOUBLE) FROM orders
UNION ALL SELECT 'quantiles', 'o_custkey', 'distinct', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders"""


@query("learn_priors", PRIORS_SQL)
def learn_priors(spark, sf):
    path = scratch_path(spark, "priors")
    L.learn_priors(table(spark, sf, "orders"), ORDER_LEARNING).write(path)
    p = L.Priors.read(spark, path)

    def part(df, prior, subject, item, value, digits):
        return df.select(F.lit(prior).alias("prior"), F.col(subject).alias("subject"), item.alias("item"), F.round(value, digits).alias("value"))

    out = part(p.category, "category", "field", F.col("value"), F.col("prob"), 6)
    out = out.unionByName(part(p.numeric, "numeric", "field", F.lit("mean"), F.col("mean"), 4))
    out = out.unionByName(part(p.conditional_numeric, "conditional_numeric", "child", F.col("parent_value"), F.col("mean"), 4))
    out = out.unionByName(part(p.conditional_category, "conditional_category", "child", F.concat("parent_value", F.lit(">"), "child_value"), F.col("prob"), 6))
    out = out.unionByName(part(p.spearman.where("a = 'o_totalprice' and b = 'o_custkey'"), "spearman", "a", F.col("b"), F.col("value"), 6))
    counts = p.quantiles.groupBy("field").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return out.unionByName(part(counts, "quantiles", "field", F.lit("distinct"), F.col("n"), 6))


@query("generate_relational")
def generate_relational(spark, sf):
    path = scratch_path(spark, "priors")
    L.learn_priors(table(spark, sf, "lineitem"), LINE_LEARNING).write(path)
    return R.generate_relational(spark, LINE_LEARNING, L.Priors.read(spark, path), seed=SEED, ids=line_ids(spark, sf))
