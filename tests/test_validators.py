import datetime

import pytest
from pyspark.sql import functions as F

from loomcast.functions import validators as V

SCOPE = V.Scope(languages=("en", "fr"), limits={"price": (0.01, 3000)}, today=datetime.date(2026, 9, 28), name="price")


def run(spark, kind, raw, params=None, json_kind="string", scope=SCOPE):
    df = spark.createDataFrame([(raw, json_kind)], "raw string, kind string")
    return df.select(V.VALIDATORS[kind](F.col("raw"), F.col("kind"), params or {}, scope).alias("o")).head().o


REJECT = [
    ("text", "", {}, "too short"), ("text", "x" * 201, {}, "too long"), ("person_name", "R2 D2", {}, "not valid in a name"), ("person_name", "--", {}, "not valid in a name"),
    ("identifier", "a_b", {}, "1-40"), ("identifier", "x" * 41, {}, "1-40"), ("address", "1234567", {}, "valid address"), ("address", "12345678", {}, "valid address"),
    ("phone", "555-1234", {}, "10-15 digits"), ("phone", "call me", {}, "invalid characters"), ("date", "tomorrow", {}, "not a recognisable"), ("date", "2027-01-01", {}, "future"),
    ("date", "2020-01-01", {}, "older than 730"), ("money", "-3", {}, "negative"), ("money", "0", {"limit": "price"}, "below the minimum"), ("money", "3000.004", {"limit": "price"}, "exceeds"),
    ("money", "x", {}, "not a valid numeric amount"), ("number", "1.5", {"integer": True}, "whole number"), ("number", "-1", {}, "reasonable range"), ("number", "x", {}, "not numeric"),
    ("regex", "12", {"patterns": [r"\d{5}"], "message": "no code"}, "no code"), ("regex", "AA", {"patterns": ["[A-Z]{2}"], "unique_chars": True}, "expected format"),
    ("regex", "1", {"patterns": ["22"], "hints": [{"pattern": "1", "message": "use 22"}]}, "use 22"),
]


@pytest.mark.parametrize(("kind", "raw", "params", "message"), REJECT)
def test_rejects(spark, kind, raw, params, message):
    out = run(spark, kind, raw, params)
    assert out.value is None and message in out.error


ACCEPT = [
    ("text", "  a b ", {}, "a b", None), ("person_name", "Zoë O’Neil-Smith", {}, "Zoë O’Neil-Smith", None), ("person_name", "Ada", {}, "Ada", "single name"), ("identifier", "007-A", {}, "007-A", None),
    ("address", "12 Main Street", {}, "12 Main Street", None), ("address", "Old Mill Road", {}, "Old Mill Road", "no street number"), ("phone", "(555) 123-4567 ext. 9", {}, "5551234567 x9", None),
    ("date", "14 mai 2026", {}, "2026-05-14", None), ("date", "1990-03-12", {"max_age_days": None}, "1990-03-12", None), ("money", "$12.345", {}, "12.35", "rounded"), ("number", "5.0", {}, "5", None),
    ("regex", " d1234 ", {"upper": True, "patterns": [r"D\d{4}"]}, "D1234", None),
]


@pytest.mark.parametrize(("kind", "raw", "params", "value", "warning"), ACCEPT)
def test_accepts(spark, kind, raw, params, value, warning):
    out = run(spark, kind, raw, params)
    assert out.error is None and out.value == value
    assert (warning is None and not out.warnings) or any(warning in w for w in out.warnings)


def test_booleans_are_neither_text_nor_numbers(spark):
    for kind in ("text", "identifier", "phone", "regex", "money", "number", "date"):
        assert run(spark, kind, "true", {"patterns": [".*"]}, "bool").error, kind


def test_custom_validator(spark):
    @V.register_validator("shout")
    def shout(raw, kind, params, scope):
        return V.outcome(F.upper(raw), F.when(raw == "no", "never"), [F.when(raw == "hm", "unsure")])

    assert run(spark, "shout", "hey").value == "HEY"
    assert run(spark, "shout", "no").error == "never"
    assert list(run(spark, "shout", "hm").warnings) == ["unsure"]
