"""Sources, sinks, projections and whole-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import coerce as C, tables as U
from tabloom.operators.generate import clamp as clamp_column
from tabloom.plans.catalog.registry import choice, query, rounded, table, u, wide
from tabloom.plans.catalog.specs import SEED, SEGMENT_PROBS, SEGMENTS, SYNTHETIC_ORDERS, STATUSES, STATUS_PROBS, PRIORITIES
from tabloom.operators.generate import generate
from tabloom.sources import tables as S
from tabloom.sources.runtime import scratch_path
from tabloom.spec import TableSpec

# ---- sources and sinks


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_csv(spark, sf):
    orders = table(spark, sf, "orders")
    path = scratch_path(spark, "orders-csv")
    S.write_table(orders, path, "csv")
    return S.scan_csv(spark, path, orders.schema)


@query("scan_head_sample", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def scan_head_sample(spark, sf):
    return S.scan_head_sample(table(spark, sf, "customer"), "c_custkey", 100)


@query("write_table", "SELECT count(*) AS \"rows\", CAST(sum(p_size) AS BIGINT) AS sizes FROM part")
def write_table(spark, sf):
    path = scratch_path(spark, "part")
    S.write_table(table(spark, sf, "part"), path)
    return S.scan_table(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("sizes"))


@query("write_chunks", """
SELECT CAST(floor(o_orderkey / 4000) AS BIGINT) AS chunk, count(*) AS "rows", min(o_orderkey) AS first_id, max(o_orderkey) AS last_id
FROM orders GROUP BY 1""")
def write_chunks(spark, sf):
    path = scratch_path(spark, "chunks")
    S.write_chunks(table(spark, sf, "orders"), path, 4000)
    return S.chunk_manifest(S.scan_table(spark, path), "o_orderkey", 4000)


@query("write_reports", """
SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1""")
def write_reports(spark, sf):
    path = scratch_path(spark, "reports")
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    S.write_reports({"status": counts}, path)
    return spark.read.schema("value string, n long").json(f"{path}/status")


DIGEST = """md5(concat_ws(chr(1), coalesce(CAST(o_orderkey AS VARCHAR), chr(2)), coalesce(CAST(o_custkey AS VARCHAR), chr(2)),
  coalesce(o_orderstatus, chr(2)), coalesce(CAST(o_orderdate AS VARCHAR), chr(2)), coalesce(o_orderpriority, chr(2))))"""


@query("table_fingerprint", f"""
WITH d AS (SELECT {DIGEST} AS d FROM orders),
p AS (SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(d, 1, 8) AS BIGINT)) AS VARCHAR) AS digest_sum,
  bit_xor(CAST('0x' || substr(d, 9, 15) AS BIGINT)) AS digest_xor FROM d)
SELECT n AS "rows", digest_sum, digest_xor,
  sha256(concat_ws(':', sha256(''), '{SEED}', CAST(n AS VARCHAR), digest_sum, CAST(digest_xor AS VARCHAR))) AS fingerprint FROM p""")
def table_fingerprint(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return S.table_fingerprint(df, seed=SEED)


# ---- projections


@query("snake_case_columns", r"""
WITH s AS (SELECT p_partkey, 'Total ' || p_name || '-' || p_brand || 'PerUnit' AS raw FROM part),
a AS (SELECT p_partkey, regexp_replace(trim(raw), '[\s\-]+', '_', 'g') AS x FROM s),
b AS (SELECT p_partkey, regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g') AS x FROM a),
c AS (SELECT p_partkey, regexp_replace(x, '[^A-Za-z0-9_]+', '_', 'g') AS x FROM b),
d AS (SELECT p_partkey, regexp_replace(x, '_+', '_', 'g') AS x FROM c)
SELECT p_partkey, trim(lower(x), '_') AS total_name FROM d""")
def snake_case_columns(spark, sf):
    raw = F.concat(F.lit("Total "), "p_name", F.lit("-"), "p_brand", F.lit("PerUnit"))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("P-PartKey"), C.snake_case_text(raw).alias("Total Name"))
    return C.snake_case_columns(df).withColumnRenamed("p_part_key", "p_partkey")


COERCE = TableSpec.from_dict({"fields": [
    {"name": "amount", "type": "int"}, {"name": "price", "type": "float"}, {"name": "flag", "type": "bool"}, {"name": "moment", "type": "datetime"}]})


@query("coerce_to_spec", """
WITH t AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN 'x' WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS amount,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) || '.25' END AS price,
  CASE o_orderkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE 'maybe' END AS flag,
  CASE WHEN o_orderkey % 83 = 0 THEN 'never' ELSE CAST(o_orderdate AS VARCHAR) END AS moment FROM orders)
SELECT o_orderkey, CAST(round_even(try_cast(amount AS DOUBLE), 0) AS BIGINT) AS amount, try_cast(price AS DOUBLE) AS price,
  CASE WHEN lower(flag) IN ('true', '1') THEN 1 WHEN lower(flag) IN ('false', '0') THEN 0 END AS flag, try_cast(moment AS TIMESTAMP) AS moment FROM t""")
def coerce_to_spec(spark, sf):
    k = F.col("o_orderkey")
    dirty = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 97 == 0, "x").when(k % 50 == 0, None).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).alias("amount"),
        F.when(k % 89 == 0, "n/a").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".25"))).alias("price"),
        F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "false").when(k % 5 == 2, "1").when(k % 5 == 3, "0").otherwise("maybe").alias("flag"),
        F.when(k % 83 == 0, "never").otherwise(F.col("o_orderdate").cast("string")).alias("moment"))
    return C.coerce_to_spec(dirty, COERCE)


@query("clamp", "SELECT c_custkey, least(5000.0, greatest(0.0, c_acctbal)) AS c_acctbal FROM customer")
def clamp(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clamp_column(F.col("c_acctbal"), 0.0, 5000.0).alias("c_acctbal"))


@query("standardize", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE l_quantity END AS q, l_extendedprice AS x FROM lineitem),
m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(x) AS mx, stddev_pop(x) AS sx FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, round((q - mq) / sq, 6) AS l_quantity, round((x - mx) / sx, 6) AS l_extendedprice FROM t, m""")
def standardize(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_orderkey") % 50 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    return rounded(C.standardize(df, ["l_quantity", "l_extendedprice"]))


@query("impute_mean", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)
SELECT o_orderkey, round(coalesce(x, (SELECT avg(x) FROM t)), 4) AS o_totalprice FROM t""")
def impute_mean(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return rounded(C.impute_mean(df, ["o_totalprice"]), 4)


@query("filter_label_rows", """
SELECT * FROM (SELECT doc_id, quality, CAST(row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS INTEGER) AS example FROM labels WHERE quality IN (0, 1)) WHERE example <= 2""")
def filter_label_rows(spark, sf):
    return C.filter_label_rows(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("drop_null_target", "SELECT o_orderkey, o_orderstatus AS target FROM orders WHERE NOT (o_orderkey % 50 = 0)")
def drop_null_target(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.col("o_orderstatus")).alias("target"))
    return C.drop_null_target(df, "target")


@query("drop_incomplete_numeric", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, o_totalprice AS price FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 50 <> 0""")
def drop_incomplete_numeric(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        k, F.when(k % 97 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("cust"), F.when(k % 50 == 0, None).otherwise(F.col("o_totalprice")).alias("price"))
    return C.drop_incomplete_numeric(df, ["cust", "price"])


# ---- whole tables

GROWTH = TableSpec.from_dict({"fields": [
    {"name": "segment", "type": "category", "categories": SEGMENTS, "probs": SEGMENT_PROBS}, {"name": "balance", "type": "float", "min": 0, "max": 5000}]})


def grown_sql(total: str) -> str:
    return f"""
WITH n AS (SELECT count(*) AS n FROM customer)
SELECT c_custkey AS _id, c_mktsegment AS segment, c_acctbal AS balance FROM customer
UNION ALL
SELECT i AS _id, {choice(SEGMENTS, SEGMENT_PROBS, u(SEED, 'segment', 'i'))}, round(5000.0e0 * {u(SEED, 'balance', 'i')}, 6)
FROM (SELECT unnest(range((SELECT n FROM n), {total})) AS i)"""


def existing_customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


@query("append_rows", grown_sql("(SELECT 2 * n FROM n)"))
def append_rows(spark, sf):
    old = existing_customers(spark, sf)
    return rounded(U.append_rows(old, GROWTH, SEED, 2 * old.count()))


@query("augment_rows", grown_sql("(SELECT n + n // 2 FROM n)"))
def augment_rows(spark, sf):
    old = existing_customers(spark, sf)
    return rounded(U.augment_rows(old, GROWTH, SEED, old.count() // 2))


TRAFFIC = TableSpec.from_dict({"fields": [
    {"name": "bytes_out", "type": "float"}, {"name": "kind", "type": "category", "categories": ["click", "view", "error"]},
    {"name": "when", "type": "datetime"}, {"name": "user", "type": "string"}, {"name": "failed", "type": "bool"}]})


@query("inject_anomalies", f"""
WITH n AS (SELECT count(*) AS n FROM events)
SELECT event_id AS _id, value AS bytes_out, event_type AS kind, ts AS "when", CAST(user_id AS VARCHAR) AS "user", CAST(event_type = 'error' AS INTEGER) AS failed, 0 AS _is_anomaly FROM events
UNION ALL
SELECT NULL, 1e9 * (1.0e0 + 0.1e0 * i), list_extract(['click', 'view', 'error'], CAST(i % 3 AS INTEGER) + 1), TIMESTAMP '2020-01-01 00:00:00', 'anom_' || CAST(i AS VARCHAR),
  CAST({u(SEED, 'anomaly/failed', 'i')} < 0.1e0 AS INTEGER), 1 FROM (SELECT unnest(range((SELECT n // 100 FROM n))) AS i)""")
def inject_anomalies(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("_id"), F.col("value").alias("bytes_out"), F.col("event_type").alias("kind"), F.col("ts").alias("when"),
        F.col("user_id").cast("string").alias("user"), (F.col("event_type") == "error").cast("int").alias("failed"))
    return U.inject_anomalies(e, TRAFFIC, "large_exfil", e.count() // 100, SEED)


SYNTHETIC_SQL = f"""
SELECT o_orderkey AS _id, CAST(0 + floor({u(SEED, 'o_custkey', 'o_orderkey')} * 1601.0e0) AS BIGINT) AS o_custkey,
  1000.0e0 + 479000.0e0 * {u(SEED, 'o_totalprice', 'o_orderkey')} AS o_totalprice,
  {choice(STATUSES, STATUS_PROBS, u(SEED, 'o_orderstatus', 'o_orderkey'))} AS o_orderstatus,
  {choice(PRIORITIES, None, u(SEED, 'o_orderpriority', 'o_orderkey'))} AS o_orderpriority FROM orders"""


def synthetic_orders(spark, sf):
    ids = wide(spark, sf, "orders", "o_orderkey", "o_orderkey").toDF("_id")
    return generate(spark, SYNTHETIC_ORDERS, SEED, ids=ids)


@query("compare_tables", f"""
WITH g AS ({SYNTHETIC_SQL}),
j AS (SELECT g._id, o.o_custkey <> g.o_custkey AS dc, o.o_totalprice <> g.o_totalprice AS dp, o.o_orderstatus <> g.o_orderstatus AS ds
  FROM orders o JOIN g ON o.o_orderkey = g._id)
SELECT count(*) AS rows_left, count(*) AS rows_right, 4 AS columns_left, 4 AS columns_right, count_if(dc OR dp OR ds) AS n_mismatch,
  min(CASE WHEN dc OR dp OR ds THEN _id END) AS first_mismatch, count_if(dc) AS diff_o_custkey, count_if(dp) AS diff_o_totalprice,
  count_if(ds) AS diff_o_orderstatus, CAST(count_if(dc OR dp OR ds) = 0 AS INTEGER) AS equal FROM j""")
def compare_tables(spark, sf):
    cols = ["o_custkey", "o_totalprice", "o_orderstatus"]
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), *cols)
    return U.compare_tables(left, synthetic_orders(spark, sf).select("_id", *cols), "_id")


@query("unexpected_values", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD') GROUP BY 1")
def unexpected_values(spark, sf):
    return U.unexpected_values(table(spark, sf, "part"), "p_type", ["ECONOMY", "STANDARD"])
