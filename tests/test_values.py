import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomcast.functions import values as N


def rows(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_money_by_locale(spark):
    cases = {
        "en": {"1,234.56": "1234.56", "$12": "12", "12.5": "12.5", "1,23": None, "(12.00)": "-12", "12-": "-12", "-12": "-12", "--12": None, "(-12)": None, "CAD 7": "7", "7 dollars": "7",
               "€ 5": "5", "+3": "3", "-+3": None, "abc": None, "": None, "−5": "-5", "$-5": "-5", "1 000": None, "USD 1,000.10": "1000.10"},
        "fr": {"1 234,56": "1234.56", "1234,5": "1234.5", "1.234,56": "1234.56", "1 234,56 $": "1234.56", "12.5": "12.5", "1,234.56": None, "249,99 $": "249.99", "3 $ CA": "3", "1,234": "1.234"},
        "mixed": {"12,5": "12.5", "1,234.56": "1234.56", "12": "12", "12.50": "12.50", "1 234,5": "1234.5"},
    }
    for locale, table in cases.items():
        got = rows(spark, list(table), N.parse_money(F.col("t"), locale)["value"])
        assert [None if g is None else g.normalize() for g in got] == [None if v is None else Decimal(v).normalize() for v in table.values()], locale


def test_ambiguous_amounts_follow_the_policy(spark):
    for policy, value in (("error", None), ("english", Decimal(1234)), ("french", Decimal("1.234"))):
        (r,) = rows(spark, ["1,234"], N.parse_money(F.col("t"), "mixed", policy))
        assert r.value == value
        assert (r.error is not None) == (policy == "error")
        assert (r.note is not None) == (policy != "error")


def test_number_takes_one_sign_and_no_currency(spark):
    table = {"5": "5", "-5": "-5", "+5": "5", "--5": None, "$5": None, "1,000": "1000", "1.5": "1.5", "5-": None}
    got = rows(spark, list(table), N.parse_number(F.col("t"), "en")["value"])
    assert [None if g is None else g.normalize() for g in got] == [None if v is None else Decimal(v).normalize() for v in table.values()]


def test_kinds_keep_booleans_and_containers_out(spark):
    df = spark.createDataFrame([("12", "int"), ("1.5", "float"), ("true", "bool"), (None, "list"), ("12", "string")], "t string, k string")
    got = [r.v for r in df.select(N.parse_money(F.col("t"), "en", "error", F.col("k"))["value"].alias("v")).collect()]
    assert got == [Decimal(12), Decimal("1.5"), None, None, Decimal(12)]


DATES = {
    "2024-05-14": (2024, 5, 14), "20240514": (2024, 5, 14), "14/05/2024": (2024, 5, 14), "14.05.2024": (2024, 5, 14), "May 1st 2026": (2026, 5, 1),
    "12-May-2025": (2025, 5, 12), "Tuesday, May 14, 2024": (2024, 5, 14), "2024-05-14T10:30:00Z": (2024, 5, 14), "03/04/2024": (2024, 4, 3), "05/14/2024": (2024, 5, 14),
    "2026 may 1": (2026, 5, 1), "1 mai 25": (2025, 5, 1), "1er mai 2025": (2025, 5, 1), "14 août 2024": (2024, 8, 14), "le 3 janv. 2024": (2024, 1, 3), "14 mai 2024 à 20 h 15": (2024, 5, 14),
    "31/02/2024": None, "13/13/2024": None, "hello": None, "2024": None, "1/2/3/4": None, "": None, "May 2024": None, "2024-13-01": None, "x" * 300: None,
}


def test_dates(spark):
    got = rows(spark, list(DATES), N.parse_date(F.col("t"), True, ("en", "fr"))["value"])
    assert got == [None if v is None else datetime.date(*v) for v in DATES.values()]


@pytest.mark.parametrize(("first", "want"), [(True, datetime.date(2024, 4, 3)), (False, datetime.date(2024, 3, 4))])
def test_day_first_decides_with_a_note(spark, first, want):
    (r,) = rows(spark, ["03/04/2024"], N.parse_date(F.col("t"), first))
    assert r.value == want and "ambiguous" in r.notes[0]


def test_locale_of_languages(spark):
    df = spark.createDataFrame([(["en"],), (["fr"],), (["en", "fr"],), ([],), (["de"],)], "l array<string>")
    pick = lambda active: [r.v for r in df.select(N.number_locale(F.col("l"), active).alias("v")).collect()]
    assert pick(("en", "fr")) == ["en", "fr", "mixed", "mixed", "mixed"]
    assert pick(("fr",))[3] == "fr"
