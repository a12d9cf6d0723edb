"""Descriptive statistics, ranks and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.operators.order import average_rank as rank_rows
from tabloom.plans.catalog.registry import average_rank as rank_sql, ppf, query, rounded, table
from tabloom.spec import TableSpec

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def stats_sql(source: str, columns: dict, moments) -> str:
    return union(
        f"SELECT '{c}' AS field, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nunique, "
        f"round(avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS null_frac, "
        + (f"round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std" if numeric else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std")
        + f" FROM {source}" for c, numeric in columns.items())


@query("field_stats", "WITH t AS (SELECT o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus, o_orderpriority FROM orders) "
       + stats_sql("t", {"o_custkey": True, "o_totalprice": True, "o_orderstatus": False, "o_orderpriority": False}, None))
def field_stats(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    return rounded(P.field_stats(df), 6, mean=4, std=4)


PART_SPEC = TableSpec.from_dict({"fields": [
    {"name": "p_size", "type": "int"}, {"name": "p_retailprice", "type": "float"}, {"name": "p_brand", "type": "category"}]})


@query("field_stats_validated", """
WITH t AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice, p_brand FROM part)
SELECT 'p_size' AS field, count(DISTINCT p_size) AS nunique, round(count_if(p_size IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_frac, round(avg(p_size), 4) AS mean,
  round(stddev_pop(p_size), 4) AS std, CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max FROM t
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), 0.0, round(avg(p_retailprice), 4), round(stddev_pop(p_retailprice), 4), min(p_retailprice), max(p_retailprice) FROM t
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), 0.0, NULL, NULL, NULL, NULL FROM t""")
def field_stats_validated(spark, sf):
    size = F.when(F.col("p_partkey") % 97 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("p_size")
    return rounded(P.field_stats_validated(table(spark, sf, "part").select(size, "p_retailprice", "p_brand"), PART_SPEC), 6, mean=4, std=4)


@query("category_prior", """
WITH c AS (SELECT unnest(['F', 'O', 'P', 'Q']) AS value), n AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1),
j AS (SELECT c.value, coalesce(n.n, 0) AS n FROM c LEFT JOIN n USING (value))
SELECT 'o_orderstatus' AS field, value, n, round((n + 1.0e0) / sum(n + 1.0e0) OVER (), 6) AS prob FROM j""")
def category_prior(spark, sf):
    return rounded(P.category_prior(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "Q"]))


@query("global_numeric", union(
    f"SELECT '{c}' AS field, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM orders"
    for c in ("o_custkey", "o_totalprice")))
def global_numeric(spark, sf):
    return rounded(P.global_numeric(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"]), 4)


PAIRS = [("c_mktsegment", "c_acctbal"), ("c_nationkey", "c_acctbal")]


@query("conditional_numeric", union(
    f"SELECT '{p}' AS parent, CAST({p} AS VARCHAR) AS parent_value, '{c}' AS child, count({c}) AS n, CASE WHEN count({c}) >= 60 THEN round(avg({c}), 4) END AS mean, "
    f"CASE WHEN count({c}) >= 60 THEN round(CASE WHEN stddev_pop({c}) = 0 THEN 1e-9 ELSE stddev_pop({c}) END, 4) END AS std, CAST(count({c}) >= 60 AS INTEGER) AS enough "
    f"FROM customer GROUP BY {p}" for p, c in PAIRS))
def conditional_numeric(spark, sf):
    return rounded(P.conditional_numeric(table(spark, sf, "customer"), PAIRS, 60), 4)


DRIVER_SPEC = TableSpec.from_dict({"fields": [{"name": "country", "type": "category"}, {"name": "role", "type": "category"}, {"name": "balance", "type": "float"}]})


@query("conditional_numeric_drivers", """
SELECT 'country' AS parent, CAST(c_nationkey AS VARCHAR) AS parent_value, 'balance' AS child, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std
FROM customer GROUP BY c_nationkey HAVING count(*) >= 10
UNION ALL SELECT 'role', c_mktsegment, 'balance', count(*), round(avg(c_acctbal), 4), round(stddev_pop(c_acctbal), 4) FROM customer GROUP BY c_mktsegment HAVING count(*) >= 10""")
def conditional_numeric_drivers(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("balance"))
    return rounded(P.conditional_numeric_drivers(df, DRIVER_SPEC, ("role", "category", "country")), 4)


@query("conditional_category_table", """
WITH c AS (SELECT DISTINCT l_linestatus AS child_value FROM lineitem), p AS (SELECT l_returnflag AS parent_value, count(*) AS samples FROM lineitem GROUP BY 1),
n AS (SELECT l_returnflag AS parent_value, l_linestatus AS child_value, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'l_returnflag' AS parent, p.parent_value, 'l_linestatus' AS child, c.child_value, samples,
  round((coalesce(n.n, 0) + 1.0e0) / (samples + (SELECT count(*) FROM c)), 6) AS prob
FROM p, c LEFT JOIN n ON n.parent_value = p.parent_value AND n.child_value = c.child_value""")
def conditional_category_table(spark, sf):
    return rounded(P.conditional_category_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("role_salary_from_table", "SELECT o_orderpriority AS role, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def role_salary_from_table(spark, sf):
    return rounded(P.role_salary_from_table(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("empirical_category_probs", """
SELECT 'event_type' AS field, event_type AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS prob FROM events GROUP BY event_type""")
def empirical_category_probs(spark, sf):
    return rounded(P.empirical_category_probs(table(spark, sf, "events"), "event_type"))


@query("class_balance", """
SELECT round(avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share, 0.5e0 AS target, CAST(abs(avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END) - 0.5e0) <= 0.05e0 + 1e-9 AS INTEGER) AS ok FROM labels""")
def class_balance(spark, sf):
    return rounded(P.class_balance(table(spark, sf, "labels"), "quality", 0.5, 0.05))


@query("group_mean_spread", """
WITH m AS (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority)
SELECT count(*) AS n_groups, round((max(m) - min(m)) / (min(m) + 1e-9), 6) AS spread, CAST(count(*) >= 2 AND (max(m) - min(m)) / (min(m) + 1e-9) < 0.05e0 AS INTEGER) AS weak FROM m""")
def group_mean_spread(spark, sf):
    return rounded(P.group_mean_spread(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query("group_summary", "SELECT p_type, round(avg(p_retailprice), 2) AS mean, round(stddev_samp(p_retailprice), 2) AS std, round(min(p_retailprice), 2) AS min, round(max(p_retailprice), 2) AS max FROM part GROUP BY 1")
def group_summary(spark, sf):
    return P.group_summary(table(spark, sf, "part"), "p_type", "p_retailprice")


@query("share_by_value", union(
    f"SELECT '{c}' AS field, {c} AS value, count(*) AS n, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")))
def share_by_value(spark, sf):
    return rounded(P.share_by_value(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("median_and_range", union(
    f"SELECT '{c}' AS field, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(median({c}), 4) AS median, "
    "CAST(NULL AS TIMESTAMP) AS first, CAST(NULL AS TIMESTAMP) AS last FROM lineitem" for c in ("l_quantity", "l_extendedprice"))
    + " UNION ALL SELECT 'l_shipdate', NULL, NULL, NULL, NULL, NULL, min(l_shipdate), max(l_shipdate) FROM lineitem")
def median_and_range(spark, sf):
    return rounded(P.median_and_range(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_shipdate"]), 4)


@query("subset_profile", """
WITH s AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, name LIMIT 3)
SELECT 'mean' AS metric, 'l_quantity' AS name, round(avg(l_quantity), 4) AS value FROM s
UNION ALL SELECT 'mean', 'l_extendedprice', round(avg(l_extendedprice), 4) FROM s
UNION ALL SELECT 'top_category', name, CAST(n AS DOUBLE) FROM t""")
def subset_profile(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(P.subset_profile(df, F.col("l_returnflag") == "R", ["l_quantity", "l_extendedprice"], "l_suppkey"), 4)


@query("duplicate_counts", """
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_keys,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows, CAST(0 AS BIGINT) AS null_cells""")
def duplicate_counts(spark, sf):
    return P.duplicate_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def moments_sql(source: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS field, count(x) AS n, round(sum(pow(x - m, 3)) / count(x) / pow(max(s), 3), 4) AS skewness, round(sum(pow(x - m, 4)) / count(x) / pow(max(s), 4) - 3, 4) AS kurtosis, "
        f"CAST(abs(sum(pow(x - m, 3)) / count(x) / pow(max(s), 3)) > 2 AS INTEGER) AS high_skew, CAST(abs(sum(pow(x - m, 4)) / count(x) / pow(max(s), 4) - 3) > 7 AS INTEGER) AS high_kurtosis "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM {source})" for c in columns)


@query("skew_kurtosis", moments_sql("events", ["value", "user_id"]))
def skew_kurtosis(spark, sf):
    return rounded(P.skew_kurtosis(table(spark, sf, "events"), ["value", "user_id"]), 4)


def entropy_sql(source: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS field, round(-sum(p * log2(p)), 6) AS entropy, round(max(p), 6) AS top_share FROM "
        f"(SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {source} GROUP BY {c})" for c in columns)


@query("entropy_top_share", entropy_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def entropy_top_share(spark, sf):
    return rounded(P.entropy_top_share(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]))


QUICK = TableSpec.from_dict({"fields": [
    {"name": "role", "type": "category"}, {"name": "status", "type": "category"}, {"name": "salary", "type": "float"}, {"name": "tail", "type": "float"}]})


@query("realism_quick_score", f"""
WITH t AS (SELECT o_orderpriority AS role, CASE WHEN o_orderkey % 40 = 0 THEN 'rare' ELSE 'usual' END AS status, o_totalprice AS salary, exp(o_totalprice / 60000.0e0) AS tail FROM orders),
k AS ({moments_sql('t', ['salary', 'tail'])}), e AS ({entropy_sql('t', ['role', 'status'])}),
m AS (SELECT avg(salary) AS m FROM t GROUP BY role),
f AS (SELECT sum(high_skew + high_kurtosis) + (SELECT count_if(top_share > 0.9) FROM e) + (SELECT CAST((max(m) - min(m)) / (min(m) + 1e-9) < 0.05 AS INTEGER) FROM m) AS n FROM k)
SELECT CAST(n AS BIGINT) AS n_flags, round(pow(0.9e0, n), 6) AS score FROM f""")
def realism_quick_score(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("role"), F.when(F.col("o_orderkey") % 40 == 0, "rare").otherwise("usual").alias("status"),
        F.col("o_totalprice").alias("salary"), F.exp(F.col("o_totalprice") / F.lit(60000.0)).alias("tail"))
    return rounded(P.realism_quick_score(df, QUICK))


# ---- ranks and correlation


def ranked_sql(source: str, columns) -> str:
    return "SELECT " + ", ".join(f"{rank_sql(c)} AS r{i}" for i, c in enumerate(columns)) + f" FROM {source}"


def matrix_sql(columns, cell) -> str:
    return union(f"SELECT '{a}' AS a, '{b}' AS b, {cell(i, j)} AS value FROM w" for i, a in enumerate(columns) for j, b in enumerate(columns))


SPEARMAN_SQL = f"WITH w AS ({ranked_sql('lineitem', LINE_NUMBERS)}) " + matrix_sql(
    LINE_NUMBERS, lambda i, j: "max(1.0e0)" if i == j else f"round(corr(r{min(i, j)}, r{max(i, j)}), 6)")


@query("spearman_matrix", SPEARMAN_SQL)
def spearman_matrix(spark, sf):
    return rounded(P.spearman_matrix(table(spark, sf, "lineitem"), LINE_NUMBERS))


SCORES_SQL = (f"r AS ({ranked_sql('lineitem', LINE_NUMBERS)}), p AS (SELECT " + ", ".join(
    f"greatest(1e-10, least(1e0 - 1e-10, (r{i} - 0.5e0) / (SELECT count(*) FROM r))) AS p{i}" for i in range(3)) + " FROM r), w AS (SELECT "
    + ", ".join(f"{ppf(f'p{i}')} AS z{i}" for i in range(3)) + " FROM p)")


@query("gaussian_covariance", f"WITH {SCORES_SQL} " + matrix_sql(LINE_NUMBERS, lambda i, j: f"round(covar_samp(z{min(i, j)}, z{max(i, j)}), 6)"))
def gaussian_covariance(spark, sf):
    return rounded(P.gaussian_covariance(table(spark, sf, "lineitem"), LINE_NUMBERS))


@query("corr_heatmap_table", f"""
WITH w AS ({ranked_sql('lineitem', LINE_NUMBERS)}), m AS ({matrix_sql(LINE_NUMBERS, lambda i, j: 'max(1.0e0)' if i == j else f'corr(r{min(i, j)}, r{max(i, j)})')}),
b AS (SELECT min(value) AS lo, max(value) AS hi FROM m)
SELECT a, b, round(value, 6) AS rho, round(255.0e0 - (value - lo) / (hi - lo + 1e-9) * 255.0e0, 6) AS scaled FROM m, (SELECT lo, hi FROM b)""")
def corr_heatmap_table(spark, sf):
    return rounded(P.corr_heatmap_table(table(spark, sf, "lineitem"), LINE_NUMBERS))


@query("average_rank", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {rank_sql('l_quantity')} AS \"rank\" FROM lineitem")
def average_rank(spark, sf):
    return rank_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity")


@query("normal_scores", f"""
WITH r AS (SELECT o_orderkey, {rank_sql('o_totalprice')} AS r FROM orders),
p AS (SELECT o_orderkey, greatest(1e-10, least(1e0 - 1e-10, (r - 0.5e0) / (SELECT count(*) FROM r))) AS p FROM r)
SELECT o_orderkey, round({ppf('p')}, 6) AS z_o_totalprice FROM p""")
def normal_scores(spark, sf):
    return rounded(P.with_normal_scores(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey")[0].select("o_orderkey", "z_o_totalprice"))


# ---- chart tables


@query("histogram", union(
    f"SELECT '{c}' AS field, CAST(least(floor(({c} - lo) / ((hi - lo) / 20.0e0)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, "
    f"(SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 2" for c in LINE_NUMBERS))
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("bar_counts", union(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")))
def bar_counts(spark, sf):
    return P.bar_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("density_grid", """
WITH c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)),
b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (SELECT count(*) - 1 FROM c) AS top FROM orders)
SELECT CAST(floor(code / CAST(greatest(1, top) AS DOUBLE) * 590.0e0) AS INTEGER) AS x,
  CAST(floor(390.0e0 - (o_totalprice - lo) / (hi - lo) * 390.0e0) AS INTEGER) AS y, count(*) AS n
FROM orders JOIN c ON o_orderpriority = v, b GROUP BY 1, 2""")
def density_grid(spark, sf):
    return P.density_grid(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@query("label_share", "SELECT 'toxic' AS label, round(max(p), 6) AS top_share FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM labels GROUP BY toxic)")
def label_share(spark, sf):
    return rounded(P.label_share(table(spark, sf, "labels"), "toxic"))


@query("head_rows", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 3")
def head_rows(spark, sf):
    return P.head_rows(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", 3)
