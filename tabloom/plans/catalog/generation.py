"""Generators: one synthetic row per row of ``orders``, keyed by its order key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import constants as K
from tabloom.functions.rng import choose, subseed, uniform
from tabloom.operators import generate as G
from tabloom.operators.order import key_index
from tabloom.plans.catalog.registry import choice, digits, listed, query, rounded, table, u, uuid, wide, z
from tabloom.plans.catalog.specs import SEED, SEGMENT_PROBS, SEGMENTS
from tabloom.spec import TableSpec


def ids(spark, sf):
    return wide(spark, sf, "orders", "o_orderkey", "o_orderkey").toDF("_id")


def of(column: str) -> str:
    return f"SELECT o_orderkey AS _id, {column} AS v FROM orders"


def single(name: str, sql: str, digits: int = 6):
    """Register a one-column generator."""
    def keep(make):
        @query(name, sql)
        def run(spark, sf):
            return rounded(ids(spark, sf).select("_id", make(F.col("_id")).alias("v")), digits)

        return make

    return keep


ID_SQL = "o_orderkey"


@single("gen_int_uniform", of(f"CAST(10 + floor({u(SEED, 'iu', ID_SQL)} * 91.0e0) AS BIGINT)"))
def gen_int_uniform(i):
    return G.int_uniform(i, SEED, "iu", 10, 100)


@single("gen_int_normal", of(f"CAST(round_even(80000.0e0 + 25000.0e0 * {z(SEED, 'in', ID_SQL)}, 0) AS BIGINT)"))
def gen_int_normal(i):
    return G.int_normal(i, SEED, "in", 80000.0, 25000.0)


@single("gen_float_uniform", of(f"round(-5.0e0 + 30.0e0 * {u(SEED, 'fu', ID_SQL)}, 6)"))
def gen_float_uniform(i):
    return G.float_uniform(i, SEED, "fu", -5.0, 25.0)


@single("gen_float_normal", of(f"round(35.0e0 + 10.0e0 * {z(SEED, 'fn', ID_SQL)}, 6)"))
def gen_float_normal(i):
    return G.float_normal(i, SEED, "fn", 35.0, 10.0)


@single("gen_category", of(choice(SEGMENTS, SEGMENT_PROBS, u(SEED, "cat", ID_SQL))))
def gen_category(i):
    return G.category(i, SEED, "cat", SEGMENTS, SEGMENT_PROBS)


@single("gen_bool", of(f"CAST({u(SEED, 'flag', ID_SQL)} < 0.3e0 AS INTEGER)"))
def gen_bool(i):
    return G.bernoulli(i, SEED, "flag", 0.3)


LOW, HIGH = "2019-03-01 00:00:00", "2024-11-15 12:30:00"
SPAN = G.as_micros(HIGH) - G.as_micros(LOW)


@single("gen_datetime", of(f"make_timestamp({G.as_micros(LOW)} + CAST(floor({u(SEED, 'when', ID_SQL)} * {float(SPAN)!r}) AS BIGINT))"))
def gen_datetime(i):
    return G.datetime_uniform(i, SEED, "when", HIGH, LOW)


SPACE = subseed(SEED, "uuid::order_id")


@single("gen_uuid", of(uuid(ID_SQL, SPACE, "order_id")))
def gen_uuid(i):
    return G.uuid_text(i, SPACE, "order_id")


MAIL = (f"lower({listed(K.FIRST_NAMES, u(SEED, 'mail/first', ID_SQL))}) || '.' || "
        f"lower({listed(K.LAST_NAMES, u(SEED, 'mail/last', ID_SQL))}) || '@' || {listed(K.MAIL_DOMAINS, u(SEED, 'mail/domain', ID_SQL))}")
PERSON = f"{listed(K.FIRST_NAMES, u(SEED, 'who/first', ID_SQL))} || ' ' || {listed(K.LAST_NAMES, u(SEED, 'who/last', ID_SQL))}"


@query("gen_text_from_list", f"SELECT o_orderkey AS _id, {listed(K.WORDS, u(SEED, 'word', ID_SQL))} AS word, {PERSON} AS person, {MAIL} AS mail FROM orders")
def gen_text_from_list(spark, sf):
    i = F.col("_id")
    return ids(spark, sf).select(
        "_id", G.word(i, SEED, "word").alias("word"), G.person_name(i, SEED, "who").alias("person"), G.email(i, SEED, "mail").alias("mail"))


@single("gen_from_examples", of(listed(["Oslo", "Lima", "Pune", "Kyiv", "Graz"], u(SEED, "examples/city", ID_SQL))))
def gen_from_examples(i):
    return choose(["Oslo", "Lima", "Pune", "Kyiv", "Graz"], uniform(SEED, "examples/city", i))


IP = digits(SEED, "ip", ID_SQL)
IP_PARTS = ", ".join(f"CAST(CAST('0x' || substr({IP}, {2 * k + 1}, 2) AS BIGINT) AS VARCHAR)" for k in range(4))


@single("gen_ipv4", of(f"concat_ws('.', {IP_PARTS})"))
def gen_ipv4(i):
    return G.ipv4(i, SEED, "ip")


@query("gen_nulls", f"SELECT o_orderkey AS _id, CASE WHEN {u(SEED, 'price/null', ID_SQL)} < 0.05e0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def gen_nulls(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(F.col("o_orderkey").alias("_id"), G.sprinkle_nulls(F.col("o_totalprice"), F.col("o_orderkey"), SEED, "price", 0.05).alias("v"))


# The bijections depend on the row count, which the SQL twin cannot turn into their two parameters,
# so it checks the properties that define them instead: exact counts and a permutation.
@query("gen_int_unique", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT n AS "rows", n AS distinct_values, CAST(1000 AS BIGINT) AS lowest, CAST(1000 + n - 1 AS BIGINT) AS highest FROM n""")
def gen_int_unique(spark, sf):
    base = key_index(ids(spark, sf), "_id", "pos")
    n = ids(spark, sf).count()
    v = base.select(G.int_unique(F.col("pos"), SEED, "code", 1000, 1000 + n - 1, n).alias("v"))
    return v.agg(F.count("v").alias("rows"), F.count_distinct("v").alias("distinct_values"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


@query("gen_label_exact", """
SELECT label, n FROM (
  SELECT 1 AS label, CAST(round_even(0.37 * count(*), 0) AS BIGINT) AS n FROM orders
  UNION ALL SELECT 0, count(*) - CAST(round_even(0.37 * count(*), 0) AS BIGINT) FROM orders)""")
def gen_label_exact(spark, sf):
    base = key_index(ids(spark, sf), "_id", "pos")
    n = ids(spark, sf).count()
    return base.select(G.label_exact(F.col("pos"), SEED, n, 0.37).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


CATEGORIES = ["electronics", "clothing", "food", "books", "toys", "garden"]
ROLES = ["engineer", "manager", "hr", "finance", "contractor", "pilot"]
DEPARTMENT = {"north": {"mean": 120.0, "std": 20.0}, "south": {"mean": 80.0, "std": 15.0}}
CONDITIONAL = TableSpec.from_dict({
    "name": "staff",
    "fields": [
        {"name": "role", "type": "category", "categories": ROLES},
        {"name": "salary", "type": "int"},
        {"name": "product_category", "type": "category", "categories": CATEGORIES},
        {"name": "price", "type": "float", "min": 5, "max": 900, "mean": 60, "std": 9},
        {"name": "area", "type": "category", "categories": ["north", "south", "west"]},
        {"name": "bonus", "type": "float", "min": 0, "max": 150, "metadata": {"conditional_on": {"area": DEPARTMENT}}},
    ],
})


def banded(bands: dict, default: tuple, parent: str, draw: str, lo=None, hi=None) -> str:
    cases = ""
    for k, (m, s) in bands.items():
        x = f"({m!r}e0 + {s!r}e0 * {draw})"
        x = f"least({float(hi)!r}, greatest({float(lo)!r}, {x}))" if lo is not None else x
        cases += f" WHEN {parent} = '{k}' THEN {x}"
    return f"(CASE{cases} ELSE {default[0]!r}e0 + {default[1]!r}e0 * {draw} END)"


@query("gen_conditional_lookup", f"""
WITH p AS (SELECT o_orderkey AS _id, {choice(ROLES, None, u(SEED, 'role', ID_SQL))} AS role,
  {choice(CATEGORIES, None, u(SEED, 'product_category', ID_SQL))} AS product_category,
  {choice(["north", "south", "west"], None, u(SEED, 'area', ID_SQL))} AS area FROM orders)
SELECT _id, role,
  CAST(round_even({banded(K.ROLE_SALARY, K.ROLE_SALARY['engineer'], 'role', z(SEED, 'salary', '_id'))}, 0) AS BIGINT) AS salary,
  product_category, round({banded(K.CATEGORY_AMOUNT, (60.0, 9.0), 'product_category', z(SEED, 'price', '_id'), 5, 900)}, 4) AS price,
  area, round({banded({k: (v['mean'], v['std']) for k, v in DEPARTMENT.items()}, (0.0, 1.0), 'area', z(SEED, 'bonus', '_id'), 0, 150)}, 4) AS bonus
FROM p""")
def gen_conditional_lookup(spark, sf):
    return rounded(G.generate(spark, CONDITIONAL, SEED, ids=ids(spark, sf)), 4)


@query("repair_unique", """
WITH w AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN k > 1 THEN p_name || '_' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS p_name FROM w""")
def repair_unique(spark, sf):
    return G.repair_unique(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("avoid_key_collision", f"""
WITH n AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey AS _id, CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer)
  THEN {uuid('o_orderkey + (SELECT n FROM o)', SPACE, 'order_id')} ELSE {uuid('o_orderkey', SPACE, 'order_id')} END AS v FROM orders""")
def avoid_key_collision(spark, sf):
    new = ids(spark, sf).withColumn("v", G.uuid_text(F.col("_id"), SPACE, "order_id"))
    old = table(spark, sf, "customer").select(G.uuid_text(F.col("c_custkey"), SPACE, "order_id").alias("v"))
    n = new.count()
    return G.avoid_key_collision(new, old, "v", lambda step: G.uuid_text(F.col("_id") + F.lit(step * n), SPACE, "order_id"))


PREVIEW = TableSpec.from_dict({
    "name": "preview",
    "fields": [
        {"name": "id", "type": "string", "format": "uuid", "unique": True},
        {"name": "segment", "type": "category", "categories": SEGMENTS, "probs": SEGMENT_PROBS},
        {"name": "amount", "type": "float", "min": 0, "max": 50},
        {"name": "active", "type": "bool", "p": 0.2},
    ],
})


@query("preview", f"""
SELECT o_orderkey AS _id, {uuid('o_orderkey', subseed(SEED, 'uuid::id'), 'id')} AS id, {choice(SEGMENTS, SEGMENT_PROBS, u(SEED, 'segment', 'o_orderkey'))} AS segment,
  round(50.0e0 * {u(SEED, 'amount', 'o_orderkey')}, 6) AS amount, CAST({u(SEED, 'active', 'o_orderkey')} < 0.2e0 AS INTEGER) AS active
FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview(spark, sf):
    first = ids(spark, sf).orderBy("_id").limit(10)
    return rounded(G.generate(spark, PREVIEW, SEED, ids=first))
