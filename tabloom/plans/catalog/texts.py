"""Redaction, page mining and priors given as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import patterns as X
from tabloom.operators import priors_json as J, text as T
from tabloom.plans import enrich as E
from tabloom.plans.catalog.registry import query, rounded, table, wide
from tabloom.spec import TableSpec


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chained(column: str, rules) -> str:
    for _, regex, mark in rules:
        column = f"regexp_replace({column}, {q(regex)}, {q(mark)}, 'g')"
    return column


# The SQL twins know ASCII word classes only. Accented letters of the given texts are written as ASCII
# words for the time of the redaction, so that their word boundaries agree.
LETTERS = "éóèñüçäêößíúáàâîôûùëïÉÓÈÑÇÊÜÖÄÍÚÁÀÂÎÔÛÙËÏ"


def spelled(column: str) -> str:
    for ch in LETTERS:
        column = f"replace({column}, '{ch}', 'Zq{ord(ch)}qZ')"
    return column


def unspelled(column: str) -> str:
    for ch in LETTERS:
        column = f"replace({column}, 'Zq{ord(ch)}qZ', '{ch}')"
    return column


@query("page_text_source")
def page_text_source(spark, sf):
    return T.page_text_source(wide(spark, sf, "pages", "page_id"))


@query("redact_pii_page", f"SELECT doc_id, {unspelled(chained(spelled('text'), X.PAGE_PII))} AS text FROM documents")
def redact_pii_page(spark, sf):
    return T.redact_pii_page(wide(spark, sf, "documents", "doc_id", "doc_id", "text"), "text")


def counted_sql(source: str) -> str:
    sql, prev = "", source
    for i, (kind, regex, mark) in enumerate(X.COUNTED_PII):
        sql += f"{', ' if i else ''}s{i} AS (SELECT * REPLACE (regexp_replace(text, {q(regex)}, {q(mark)}, 'g') AS text), len(regexp_extract_all(text, {q(regex)})) AS n_{kind} FROM {prev})"
        prev = f"s{i}"
    return sql


KINDS = [k for k, _, _ in X.COUNTED_PII]
LAST = f"s{len(KINDS) - 1}"


# Here the plain classes serve both sides.
@query("redact_pii_counts", f"WITH {counted_sql('documents')} SELECT doc_id, text, {', '.join(f'CAST(n_{k} AS INTEGER) AS n_{k}' for k in KINDS)} FROM {LAST}")
def redact_pii_counts(spark, sf):
    return T.redact_pii_counts(wide(spark, sf, "documents", "doc_id", "doc_id", "text"), "text", unicode=False)


@query("pii_summary", f"WITH {counted_sql('documents')} " + " UNION ALL ".join(
    f"SELECT lang, source, '{k}' AS kind, count_if(n_{k} > 0) AS rows_hit, CAST(sum(n_{k}) AS BIGINT) AS hits FROM {LAST} GROUP BY lang, source" for k in KINDS))
def pii_summary(spark, sf):
    return T.pii_summary(wide(spark, sf, "documents", "doc_id"), "text", ["lang", "source"], unicode=False)


@query("mine_numbers", f"""
WITH h AS (SELECT unnest(regexp_extract_all(text, {q(X.NUMBER)}, 1)) AS hit FROM documents), x AS (SELECT try_cast(replace(hit, ',', '') AS DOUBLE) AS x FROM h)
SELECT count(x) AS samples, round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS std, min(x) AS min, max(x) AS max FROM x WHERE x >= 1000 AND x <= 1e7""")
def mine_numbers(spark, sf):
    return rounded(T.mine_numbers(wide(spark, sf, "documents", "doc_id"), "text", "salary"), 2)


WORDS = ["tion", "ing", "ment", "und"]


@query("mine_category_shares", f"""
WITH w AS (SELECT lower(unnest(regexp_extract_all(text, {q(X.TOKEN)}))) AS w FROM documents WHERE contains(lower(text), 'on')),
c AS (SELECT c AS value, count(*) AS samples FROM w JOIN (SELECT unnest({WORDS!r}) AS c) ON contains(w, c) GROUP BY 1)
SELECT value, samples, round(samples / CAST(sum(samples) OVER () AS DOUBLE), 6) AS prob FROM c""")
def mine_category_shares(spark, sf):
    return rounded(T.mine_category_shares(wide(spark, sf, "documents", "doc_id"), "text", "on", WORDS))


@query("mine_examples", f"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E]')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E]'), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l),
k AS (SELECT doc_id, pos, {unspelled(chained(spelled('line'), X.PAGE_PII))} AS example FROM t WHERE line <> '' AND (contains(lower(line), 'salary') OR len(string_split_regex(line, '\\s+')) <= 12)),
f AS (SELECT example, min({{'d': doc_id, 'p': pos}}) AS place FROM k GROUP BY 1 ORDER BY place LIMIT 50)
SELECT place.d AS doc_id, CAST(place.p AS INTEGER) AS pos, example FROM f""")
def mine_examples(spark, sf):
    return T.mine_examples(wide(spark, sf, "documents", "doc_id"), "text", "doc_id", "salary")


@query("merge_mined_priors", f"""
WITH h AS (SELECT lang, unnest(regexp_extract_all(text, {q(X.NUMBER)}, 1)) AS hit FROM documents), x AS (SELECT * FROM (SELECT lang, try_cast(replace(hit, ',', '') AS DOUBLE) AS x FROM h) WHERE x BETWEEN 1000 AND 1e7),
m AS (SELECT lang AS field, count(x) AS samples, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max FROM x GROUP BY lang),
b AS (SELECT lang AS field, avg(n_chars) AS mean, stddev_pop(n_chars) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY lang)
SELECT b.field, round(CASE WHEN m.samples >= 5 THEN m.mean ELSE b.mean END, 2) AS mean, round(CASE WHEN m.samples >= 5 AND m.std IS NOT NULL THEN greatest(1e-9, m.std) ELSE b.std END, 2) AS std,
  round(CASE WHEN m.samples >= 5 THEN greatest(b.min, m.min) ELSE b.min END, 2) AS min, round(CASE WHEN m.samples >= 5 THEN least(b.max, m.max) ELSE b.max END, 2) AS max
FROM b LEFT JOIN m USING (field)""")
def merge_mined_priors(spark, sf):
    d = wide(spark, sf, "documents", "doc_id")
    base = d.groupBy(F.col("lang").alias("field")).agg(
        F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("std"), F.min("n_chars").cast("double").alias("min"), F.max("n_chars").cast("double").alias("max"))
    hits = d.select("lang", F.explode(F.regexp_extract_all("text", F.lit(X.NUMBER), F.lit(1))).alias("hit"))
    x = F.col("x")
    hits = hits.select("lang", F.replace(F.col("hit"), F.lit(","), F.lit("")).try_cast("double").alias("x")).where(x.between(1000, 1e7))
    mined = hits.groupBy(F.col("lang").alias("field")).agg(
        F.count(x).alias("samples"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return rounded(T.merge_mined_priors(base, mined), 2)


# ---- a specification enriched from the documents

MINED = TableSpec.from_dict({"fields": [
    {"name": "salary", "type": "int", "mean": 100, "std": 5, "min": 1200, "max": 900000}, {"name": "amount", "type": "float", "min": 3, "max": 5000},
    {"name": "nothing", "type": "float", "mean": 1}, {"name": "ending", "type": "category", "categories": ["tion", "ing", "ment", "zzz"]},
    {"name": "quiet", "type": "category", "categories": ["a", "b"], "probs": [0.25, 0.75]}]})
HINTS = {"salary": "salary", "amount": "on", "nothing": "no text says this", "ending": "er", "quiet": "qqzz"}


@query("enrich_numbers", f"""
WITH s AS (SELECT * FROM (VALUES ('salary', 'salary', 100.0e0, 5.0e0, 1200.0e0, 900000.0e0), ('amount', 'on', NULL, NULL, 3.0e0, 5000.0e0), ('nothing', 'no text says this', 1.0e0, NULL, 0.0e0, 100.0e0)) AS t(field, hint, mean, std, lo, hi)),
h AS (SELECT field, unnest(regexp_extract_all(text, {q(X.NUMBER)}, 1)) AS hit FROM s JOIN documents ON contains(lower(text), hint)),
x AS (SELECT * FROM (SELECT field, try_cast(replace(hit, ',', '') AS DOUBLE) AS x FROM h) WHERE x IS NOT NULL AND (field <> 'salary' OR x BETWEEN 1000 AND 1e7)),
m AS (SELECT field, avg(x) AS a, coalesce(stddev_samp(x), 0) AS b, min(x) AS c, max(x) AS d FROM x GROUP BY field HAVING count(*) >= 5)
SELECT field, round(coalesce(a, mean), 2) AS mean, round(CASE WHEN b IS NOT NULL THEN greatest(1e-9, b) ELSE std END, 2) AS std,
  round(CASE WHEN c IS NOT NULL THEN greatest(lo, c) ELSE lo END, 2) AS min, round(CASE WHEN d IS NOT NULL THEN least(hi, d) ELSE hi END, 2) AS max FROM s LEFT JOIN m USING (field)""")
def enrich_numbers(spark, sf):
    hints = {f: HINTS[f] for f in ("salary", "amount", "nothing")}
    return rounded(E.enriched_numbers(MINED, E.texts_by_field(wide(spark, sf, "documents", "doc_id", "doc_id", "text"), "text", "doc_id", hints), hints), 2)


@query("enrich_shares", f"""
WITH c AS (SELECT unnest(['tion', 'ing', 'ment', 'zzz']) AS value), w AS (SELECT lower(unnest(regexp_extract_all(text, {q(X.TOKEN)}))) AS w FROM documents WHERE contains(lower(text), 'er')),
n AS (SELECT value, count(w) AS n FROM c LEFT JOIN w ON contains(w, value) GROUP BY value)
SELECT 'ending' AS field, value, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS prob FROM n UNION ALL SELECT 'quiet', 'a', 0.25e0 UNION ALL SELECT 'quiet', 'b', 0.75e0""")
def enrich_shares(spark, sf):
    hints = {f: HINTS[f] for f in ("ending", "quiet")}
    return rounded(E.enriched_shares(MINED, E.texts_by_field(wide(spark, sf, "documents", "doc_id", "doc_id", "text"), "text", "doc_id", hints), hints))


# ---- priors as JSON: one answer text per brand, some of them damaged


def answers(spark, sf):
    """(doc, answer, damage): the price prior of each brand, written the way a text model answers."""
    g = table(spark, sf, "part").groupBy("p_brand").agg(
        F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"),
        F.count_if(F.col("p_type") == "ECONOMY").alias("e"), F.count_if(F.col("p_type") != "ECONOMY").alias("o"))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    body = F.format_string(
        '{"schema_hint":{"columns":[]},"priors":{"kind":{"type":"categorical","categories":["ECONOMY","OTHER"],"probs":[%d,%d]},'
        '"price":{"type":"numeric","distribution":{"type":"normal","params":{"mean":%.4f,"std":%.4f}},'
        '"conditionals":[{"when":{"kind":"ECONOMY"},"distribution":{"params":{"mean":%.4f,"std":5.5}}}]}},'
        '"dependencies":[{"parent":"kind","child":"price"}],"examples":[]}', "e", "o", "m", "s", "m")
    damage = F.pmod(number, F.lit(5))
    text = (
        F.when(damage == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nWrite to a.b@example.com")))
        .when(damage == 2, F.replace(body, F.lit('"examples":[]'), F.lit('"other":[]')))
        .when(damage == 3, F.replace(body, F.lit('"distribution":{"type"'), F.lit('"spread":{"type"')))
        .when(damage == 4, F.lit("I cannot answer that."))
        .otherwise(body))
    return g.select(F.col("p_brand").alias("doc"), text.alias("answer"), damage.alias("damage"))


@query("parse_priors_json", """
SELECT p_brand AS doc, CAST(d IN (0, 1) AS INTEGER) AS is_valid,
  CASE d WHEN 2 THEN 'missing key examples' WHEN 3 THEN 'price: no distribution' WHEN 4 THEN 'no JSON object' ELSE '' END AS problems, CAST(d = 1 AS INTEGER) AS n_redactions
FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 AS d FROM part)""")
def parse_priors_json(spark, sf):
    out = J.parse_priors_json(answers(spark, sf), "answer")
    return out.select("doc", "is_valid", F.array_join("problems", ";").alias("problems"), "n_redactions")


@query("normalize_prior_probs", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_brand, count(*) AS k, sum(n) AS s FROM c GROUP BY 1)
SELECT p_brand, p_type AS category, round(CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 3 = 0 THEN 1.0e0 / k ELSE n / CAST(s AS DOUBLE) END, 6) AS prob FROM c JOIN t USING (p_brand)""")
def normalize_prior_probs(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_type", F.col("n").cast("double").alias("n")))).alias("a"))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    # Every third brand loses its last probability, so the lengths differ there.
    probs = F.when(number % 3 == 0, F.slice(F.col("a.n"), F.lit(1), F.size("a") - 1)).otherwise(F.col("a.n"))
    out = J.normalize_prior_probs(packed.select("p_brand", F.col("a.p_type").alias("categories"), probs.alias("probs")))
    return rounded(out.select("p_brand", F.explode(F.arrays_zip("categories", "probs")).alias("z")).select(
        "p_brand", F.col("z.categories").alias("category"), F.col("z.probs").alias("prob")))


@query("priors_to_tables", """
WITH g AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, count_if(p_type = 'ECONOMY') AS e, count(*) AS n, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 AS d FROM part GROUP BY 1),
v AS (SELECT *, round(m, 4) AS m4, round(s, 4) AS s4 FROM g WHERE d IN (0, 1))
SELECT p_brand AS doc, 'category' AS kind, 'kind=ECONOMY' AS item, round(e / CAST(n AS DOUBLE), 4) AS value FROM v
UNION ALL SELECT p_brand, 'category', 'kind=OTHER', round((n - e) / CAST(n AS DOUBLE), 4) FROM v
UNION ALL SELECT p_brand, 'numeric', 'price', m4 FROM v UNION ALL SELECT p_brand, 'conditional_numeric', 'kind=ECONOMY>price', m4 FROM v
UNION ALL SELECT p_brand, 'edges', 'kind>price', 1.0 FROM v""")
def priors_to_tables(spark, sf):
    parsed = J.parse_priors_json(answers(spark, sf), "answer").where("is_valid = 1")
    t = J.priors_to_tables(parsed, "doc")

    def part(df, kind, item, value):
        return df.select("doc", F.lit(kind).alias("kind"), item.alias("item"), F.round(value, 4).alias("value"))

    out = part(t["category"], "category", F.concat("field", F.lit("="), "value"), F.col("prob"))
    out = out.unionByName(part(t["numeric"], "numeric", F.col("field"), F.col("mean")))
    out = out.unionByName(part(t["conditional_numeric"], "conditional_numeric", F.concat("parent", F.lit("="), "parent_value", F.lit(">"), "child"), F.col("mean")))
    return out.unionByName(part(t["edges"], "edges", F.concat("parent", F.lit(">"), "child"), F.lit(1.0)))
