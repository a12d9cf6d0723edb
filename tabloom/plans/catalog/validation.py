"""Validation rules on ``orders`` with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import validate as V
from tabloom.plans.catalog.registry import query, table
from tabloom.plans.catalog.specs import ORDERS_RULES
from tabloom.spec import TableSpec
from tabloom.streaming.windowed import closed_windows

AS_OF = "2001-01-01 00:00:00"

DIRTY_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 97 = 0 THEN 'x' WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
  o_orderdate AS start_date, CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_orderpriority AS wrong, o_orderstatus AS junk, o_orderpriority AS extra FROM orders"""


def dirty_orders(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 97 == 0, "x").when(k % 50 == 0, None).otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        F.col("o_orderdate").alias("start_date"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_orderpriority").alias("wrong"), F.col("o_orderstatus").alias("junk"), F.col("o_orderpriority").alias("extra"))


FACTS = f"""WITH t AS ({DIRTY_SQL}), x AS (SELECT *, try_cast(price_text AS DOUBLE) AS price FROM t),
a AS (SELECT CAST(count(*) AS BIGINT) AS n, count_if(price < 5000) AS lo, count_if(price > 400000) AS hi, count_if(price IS NULL) AS nulls,
  count(DISTINCT o_custkey) AS nu, count_if(o_custkey > 1000) AS cust_hi, count_if(start_date > TIMESTAMP '{AS_OF}') AS future, count_if(label = 1) AS ones, count(junk) AS junk FROM x)
"""
# rule -> (field, n_bad, message, condition) rows over the facts
ROWS = {
    "missing_field": [("absent", "1", "'absent: column is absent from the table'", "true")],
    "unsupported_type": [("wrong", "1", "'wrong: type decimal128 is not known'", "true")],
    "not_numeric": [("junk", "junk", "'junk: no value can be read as a number'", "junk > 0")],
    "below_min": [("price_text", "lo", "'price_text: ' || lo || ' values below min 5000'", "lo > 0")],
    "above_max": [("price_text", "hi", "'price_text: ' || hi || ' values above max 400000'", "hi > 0"),
                  ("o_custkey", "cust_hi", "'o_custkey: ' || cust_hi || ' values above max 1000'", "cust_hi > 0")],
    "null_fraction": [
        ("price_text", "nulls", "'price_text: share of nulls ' || printf('%.3f', nulls / CAST(n AS DOUBLE)) || ', at most 0.010 wanted'", "nulls / CAST(n AS DOUBLE) > 0.01 + 1e-9"),
        ("junk", "n", "'junk: share of nulls 1.000, at most 0.000 wanted'", "n > 0")],
    "unique": [("o_custkey", "n - nu", "'o_custkey: uniqueness does not hold, ' || nu || ' distinct values in ' || n || ' rows'", "n <> nu")],
    "future_timestamp": [("start_date", "future", "'start_date: ' || future || ' timestamps are in the future'", "future > 0")],
    "class_balance": [("label", "ones", "'label: share of ones ' || printf('%.3f', ones / CAST(n AS DOUBLE)) || ', wanted 0.250 within 0.010'",
                       "abs(ones / CAST(n AS DOUBLE) - 0.25) > 0.01 + 1e-9")],
}


def findings_sql(rules) -> str:
    return FACTS + " UNION ALL ".join(
        f"SELECT '{field}' AS field, '{rule}' AS rule, CAST({bad} AS BIGINT) AS n_bad, {text} AS message FROM a WHERE {when}"
        for rule in rules for field, bad, text, when in ROWS[rule])


def findings(spark, sf, rules=None):
    return V.validate_table(dirty_orders(spark, sf), ORDERS_RULES, as_of=AS_OF, only=rules)


for _rule in ("unsupported_type", "not_numeric", "below_min", "above_max", "null_fraction", "unique", "future_timestamp", "class_balance"):
    query(f"val_{_rule}", findings_sql([_rule]))(lambda spark, sf, rule=_rule: findings(spark, sf, {rule}))

query("validate_table", findings_sql(ROWS))(findings)


@query("val_missing_field", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'absent' AS field, 'missing_field' AS rule, CAST(1 AS BIGINT) AS n_bad, 'absent: column is absent from the table' AS message, 'error' AS severity, n AS checked_rows FROM n
UNION ALL SELECT 'extra', 'unexpected_column', 1, 'extra: column is not declared', 'warning', n FROM n""")
def val_missing_field(spark, sf):
    df = dirty_orders(spark, sf)
    n = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return V.column_findings(df, ORDERS_RULES).withColumn("checked_rows", n)


@query("row_quarantine", f"""
WITH t AS ({DIRTY_SQL}), x AS (SELECT *, try_cast(price_text AS DOUBLE) AS price FROM t)
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN o_custkey > 1000 THEN 'o_custkey:above_max' END,
  CASE WHEN price_text IS NOT NULL AND price IS NULL THEN 'price_text:not_numeric' END,
  CASE WHEN price < 5000 THEN 'price_text:below_min' END, CASE WHEN price > 400000 THEN 'price_text:above_max' END,
  CASE WHEN start_date > TIMESTAMP '{AS_OF}' THEN 'start_date:future' END,
  'junk:not_numeric'], lambda v: v IS NOT NULL), ',') AS violations FROM x""")
def row_quarantine(spark, sf):
    good, bad = V.row_quarantine(dirty_orders(spark, sf), ORDERS_RULES, AS_OF)
    return bad.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


# ---- windows of event time, on a stream

WINDOWED = TableSpec.from_dict({"fields": [{"name": "value", "type": "float", "min": 5, "max": 120}, {"name": "user_id", "type": "int", "min": 1, "max": 900}]})


@query("val_windowed", """
WITH e AS (SELECT date_trunc('day', ts) AS d, value, user_id, max(ts) OVER () AS latest FROM events),
g AS (SELECT d, count(*) AS n, count_if(value < 5) AS v0, count_if(value > 120) AS v1, count_if(value IS NULL) AS v2, count_if(user_id < 1) AS u0, count_if(user_id > 900) AS u1, count_if(user_id IS NULL) AS u2
  FROM e WHERE d + INTERVAL 1 DAY <= latest - INTERVAL 1 HOUR GROUP BY d),
r AS (SELECT d, n, unnest([{'f': 'value', 'r': 'below_min', 'b': v0}, {'f': 'value', 'r': 'above_max', 'b': v1}, {'f': 'value', 'r': 'null_fraction', 'b': v2},
  {'f': 'user_id', 'r': 'below_min', 'b': u0}, {'f': 'user_id', 'r': 'above_max', 'b': u1}, {'f': 'user_id', 'r': 'null_fraction', 'b': u2}]) AS c FROM g)
SELECT strftime(d, '%Y-%m-%d') AS window_start, c.f AS field, c.r AS rule, n AS n_rows, c.b AS n_bad, CAST(c.b = 0 AS INTEGER) AS ok FROM r""")
def val_windowed(spark, sf):
    """The events as a stream of files; days that its watermark has passed."""
    kinds = table(spark, sf, "events").select("ts", "value", "user_id").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf}/events.parque[t]")
    found = closed_windows(stream, WINDOWED, "ts", "1 day", "1 hour")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
