"""Enrichment of a specification by texts, and numeric priors in generation."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators.generate import generate
from tabloom.plans import enrich as E, full_run
from tabloom.spec import TableSpec

SPEC = TableSpec.from_dict({"fields": [
    {"name": "price", "type": "float", "min": 2, "max": 50}, {"name": "salary", "type": "int", "mean": 7, "std": 1, "min": 0},
    {"name": "colour", "type": "category", "categories": ["red", "blue", "teal"]}, {"name": "size", "type": "category", "categories": ["small", "large"], "probs": [0.5, 0.5]},
    {"name": "remark", "type": "string"}, {"name": "when", "type": "datetime"}]})

TEXTS = [
    (1, "The price was 10 and then 20.\ncolour: Red, darkred or blue"),
    (2, "PRICE 30 price 40\nmail me at jane.doe@example.org"),
    (3, "price of $1,000 only\na remark about nothing"),
    (4, "the salary is 45,000 or 55000 or 12 or 65000 or 75000 or 85000"),
    (5, "colour blue blueish\nA line that is far too long to be taken as an example, since it has more words than the dozen that may stand"),
    (6, None), (7, ""), (8, "size: small")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(TEXTS, "page_id long, text string").repartition(3)


def test_numbers_and_shares_are_taken_over(pages):
    spec, report = E.enrich(SPEC, pages, hints={"remark": "remark"})
    price, salary = spec["price"], spec["salary"]
    assert (price.mean, price.min, price.max) == (pytest.approx(220.0), 10.0, 50.0)  # tighter below, never wider above
    assert (salary.mean, salary.min, salary.max) == (pytest.approx(65000.0), 45000.0, 85000.0)
    assert spec["colour"].probs == (0.4, 0.6, 0.0) and spec["colour"].categories == ("red", "blue", "teal")
    assert spec["size"].probs == (0.5, 0.5) and spec["when"] == SPEC["when"]  # one hit is too few
    said = {(r.field, r.kind): r.changed for r in report.collect()}
    assert said == {("price", "number"): True, ("salary", "number"): True, ("colour", "category"): True, ("size", "category"): False, ("remark", "string"): True}
    assert spec.metadata["crawl_examples"] == {"remark": ["price of $1,000 only", "a remark about nothing"]}


def test_examples_are_redacted_first_and_few(pages):
    heard = E.texts_by_field(pages, "text", "page_id", {"price": "price", "colour": "colour"})
    got = [tuple(r) for r in E.mined_examples(heard, {"price": "price", "colour": "colour"}, most=3).orderBy("field", "place").collect()]
    assert [g[:2] for g in got] == [("colour", 1), ("colour", 2), ("colour", 3), ("price", 1), ("price", 2), ("price", 3)]
    assert got[2][2] == "colour blue blueish" and not any("jane" in g[2] for g in E.mined_examples(heard, {"price": "price", "colour": "colour"}).collect())


def test_texts_that_say_nothing(spark, pages):
    for texts in (pages.where("false"), pages.where("page_id >= 6")):
        spec, report = E.enrich(SPEC.with_fields(salary={"mean": 7}), texts, hints={f: "unsaid" for f in SPEC.names()})
        assert spec == SPEC and not any(r.changed for r in report.collect())


def test_run_generates_from_the_enriched_specification(spark, pages):
    out = full_run.run(spark, SPEC, 3, 300, texts=pages, hints={"remark": "remark"})
    rows = out["table"].collect()
    assert {r.colour for r in rows} == {"red", "blue"} and {r.remark for r in rows} == {"price of $1,000 only", "a remark about nothing"}
    assert all(10 <= r.price <= 50 for r in rows) and out["mined"].count() == 5


def test_numeric_priors_fill_what_a_field_lacks(spark):
    priors = {"priors": {"x": {"type": "numeric", "distribution": {"mean": 50.0, "std": 2.0}},
                         "y": {"type": "numeric", "distribution": {"type": "normal", "params": {"mean": -8.0, "std": 0.5}}},
                         "z": {"type": "numeric", "distribution": {"mean": 1e9}}, "salary": {"type": "numeric", "distribution": {"min": 10, "max": 12}},
                         "bad": {"type": "numeric", "distribution": "flat"}, "cat": {"type": "categorical", "categories": ["u", "v"], "probs": [1.0, 0.0]}}}
    spec = TableSpec.from_dict({"metadata": {"llm_priors": priors}, "fields": [
        {"name": "x", "type": "float", "distribution": "normal"}, {"name": "y", "type": "int", "distribution": "normal"},
        {"name": "z", "type": "float", "distribution": "normal", "mean": 5, "std": 1}, {"name": "salary", "type": "int"},
        {"name": "bad", "type": "float"}, {"name": "cat", "type": "category", "categories": ["a"]}]})
    got = generate(spark, spec, 1, 2000).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")], F.min("salary").alias("lo"), F.max("salary").alias("hi"),
                                           F.stddev_pop("x").alias("sx"), F.collect_set("cat").alias("cat"), F.max("bad").alias("bad")).first()
    assert abs(got.x - 50) < 0.2 and abs(got.sx - 2) < 0.2 and abs(got.y + 8) < 0.1
    assert abs(got.z - 5) < 0.2  # a field's own moments win
    assert (got.lo, got.hi) == (10, 12) and got.cat == ["u"] and got.bad <= 100
