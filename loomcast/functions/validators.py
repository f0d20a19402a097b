"""Field validators as builders of struct columns ``(value string, number decimal, error, warnings)``.

A validator is ``f(raw, kind, params, context) -> Column``.  ``raw`` is the text
of the cell, ``kind`` its JSON type (string, int, float, bool, list, object),
``params`` the field's parameters and ``context`` the run (settings, today,
languages, limits, locale column).  ``register_validator`` adds one.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcast.functions import values
from loomcast.functions.text import let, strip


@dataclass
class Scope:
    """What validators may ask about the run."""

    settings: dict = field(default_factory=dict)
    languages: tuple = ("en",)
    limits: dict = field(default_factory=dict)
    today: datetime.date = datetime.date(2000, 1, 1)
    locale: object = "en"
    name: str = ""
    vocabulary_match: Callable | None = None


VALIDATORS: dict[str, Callable] = {}


def register_validator(name: str):
    """Add a validator under a name that configs may use; it must be registered before the config is loaded."""

    def add(f: Callable) -> Callable:
        VALIDATORS[name] = f
        return f

    return add



def _null() -> Column:
    return F.lit(None).cast("string")


def outcome(value: Column | None = None, error: Column | None = None, warnings: list | Column | None = None, number: Column | None = None) -> Column:
    nothing = F.array().cast("array<string>")
    warn = warnings if isinstance(warnings, Column) else F.array_compact(F.array(*warnings)) if warnings else nothing
    null = lambda kind: F.lit(None).cast(kind)
    raw = F.struct(
        (null("string") if value is None else value.cast("string")).alias("value"), (null(values.DECIMAL) if number is None else number.cast(values.DECIMAL)).alias("number"),
        (null("string") if error is None else error).alias("error"), warn.alias("warnings"),
    )
    failed = lambda o: F.struct(null("string").alias("value"), null(values.DECIMAL).alias("number"), o["error"].alias("error"), nothing.alias("warnings"))
    return let(raw, lambda o: F.when(o["error"].isNull(), o).otherwise(failed(o)))


def ok(value: Column, *warnings: Column) -> Column:
    return outcome(value, None, list(warnings))


def fail(message: Column | str) -> Column:
    return outcome(None, F.lit(message) if isinstance(message, str) else message)


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text_error(t: Column, kind: Column, params: dict) -> Column:
    low, high = params.get("min_length", 1), params.get("max_length", 200)
    return (
        F.when(kind != "string", "value must be text")
        .when(F.char_length(t) < low, f"value is too short (minimum {low} characters)")
        .when(F.char_length(t) > high, f"value is too long (maximum {high} characters)")
    )


@register_validator("text")
def text(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    return let(strip(raw), lambda t: outcome(t, _text_error(t, kind, params)))


@register_validator("person_name")
def person_name(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    return let(strip(raw), lambda t: _name(t, kind, params))


def _name(t: Column, kind: Column, params: dict) -> Column:
    bad = ~t.rlike(r"(?U)\A[\p{L}\s'’.,\-\p{Mn}]+\z") | ~t.rlike(r"\p{L}")
    error = F.coalesce(_text_error(t, kind, params), F.when(bad, said("'", t, "' contains characters that are not valid in a name")))
    single = F.when(~t.rlike(r"(?U)\S\s+\S"), said("'", t, "' looks like a single name; a full name is expected"))
    return outcome(t, error, [single])


@register_validator("identifier")
def identifier(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    return let(strip(raw), lambda t: _identifier(t, kind))


def _identifier(t: Column, kind: Column) -> Column:
    error = F.when(~kind.isin("string", "int"), "identifier must be a string or an integer").when(
        ~t.rlike(r"\A[A-Za-z0-9][A-Za-z0-9\-/ .]{0,39}\z"), "identifier must contain 1-40 alphanumeric, space, slash, hyphen or period characters"
    )
    return outcome(t, error)


@register_validator("address")
def address(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    return let(strip(raw), lambda t: _address(t, kind, params))


def _address(t: Column, kind: Column, params: dict) -> Column:
    weak = (F.char_length(t) < 8) | ~t.rlike(r"\p{L}")
    error = F.coalesce(_text_error(t, kind, params), F.when(weak, said("'", t, "' does not look like a valid address")))
    return outcome(t, error, [F.when(~t.rlike(r"\p{Nd}"), said("address '", t, "' has no street number"))])


@register_validator("phone")
def phone(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    tail = r"(?i)\s*(?:ext\.?|poste|p\.|x)\s*(\d+)\s*$"
    cut = lambda t: F.struct(F.regexp_extract(t, tail, 1).alias("extension"), F.regexp_replace(t, tail, "").alias("body"))
    return let(let(strip(raw), cut), lambda p: let(F.regexp_replace(p["body"], r"\D", ""), lambda digits: _phone(p["body"], p["extension"], digits, kind)))


def _phone(body: Column, extension: Column, digits: Column, kind: Column) -> Column:
    error = (
        F.when(~kind.isin("string", "int"), "phone number must be text or an integer")
        .when(body.rlike(r"(?U)[^\d\s()+\-.]"), "phone number contains invalid characters")
        .when(~F.char_length(digits).between(10, 15), "phone number requires 10-15 digits")
    )
    return outcome(F.concat(digits, F.when(extension != "", F.concat(F.lit(" x"), extension)).otherwise("")), error)


@register_validator("date")
def date(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    parsed = values.parse_date(raw, scope.settings.get("day_first", True), scope.languages)
    return let(parsed, lambda p: _date(p, raw, kind, params, scope))


def _date(parsed: Column, raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    day = F.when(kind.isin("string", "int"), parsed["value"])
    iso = F.date_format(day, "yyyy-MM-dd")
    future = params.get("allow_future", scope.settings.get("allow_future_dates", False))
    limit = params["max_age_days"] if "max_age_days" in params else scope.settings.get("max_age_days", 730)
    today = F.lit(scope.today)
    error = F.when(day.isNull(), said("'", raw, "' is not a recognisable date"))
    if not future:
        error = error.when(day > today, said("date ", iso, " is in the future"))
    if limit is not None:
        error = error.when(F.datediff(today, day) > limit, said("date ", iso, f" is older than {limit} days"))
    return outcome(iso, error, parsed["notes"])


def plain(d: Column) -> Column:
    """A decimal without padding zeros."""
    return F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


@register_validator("money")
def money(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    parsed = values.parse_money(raw, scope.locale, scope.settings.get("ambiguous_number_policy", "error"), kind)
    return let(parsed, lambda p: _money(p, raw, params, scope))


def _money(parsed: Column, raw: Column, params: dict, scope: Scope) -> Column:
    v = parsed["value"]
    low, high = scope.limits.get(params.get("limit"), (0, None))
    locale = F.lit(scope.locale) if isinstance(scope.locale, str) else scope.locale
    error = (
        F.when(parsed["error"].isNotNull(), said("amount ", parsed["error"]))
        .when(v.isNull(), said("'", raw, "' is not a valid numeric amount (number format: ", locale, ")"))
        .when(v < 0, said("amount ", plain(v), " is negative; negative amounts are not accepted"))
        .when(v < F.lit(str(low)).cast(values.DECIMAL), said("amount ", plain(v), f" is below the minimum {low:.2f}"))
    )
    if high is not None:
        error = error.when(v > F.lit(str(high)).cast(values.DECIMAL), said("amount ", plain(v), f" exceeds the reasonable maximum {high:.2f} for {scope.name}"))
    cents = F.round(v, 2)
    rounded = F.when(cents != v, said("amount ", plain(v), " has more than 2 decimal places; rounded"))
    return outcome(plain(cents), error, [parsed["note"], rounded], cents)


@register_validator("number")
def number(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    parsed = values.parse_number(raw, scope.locale, scope.settings.get("ambiguous_number_policy", "error"), kind)
    return let(parsed, lambda p: _number(p, params, scope))


def _number(parsed: Column, params: dict, scope: Scope) -> Column:
    v = parsed["value"]
    low, high = params.get("minimum", 0), params.get("maximum", 1000000)
    locale = F.lit(scope.locale) if isinstance(scope.locale, str) else scope.locale
    error = F.when(parsed["error"].isNotNull(), said("value ", parsed["error"])).when(v.isNull(), said("value is not numeric (number format: ", locale, ")"))
    if params.get("integer"):
        error = error.when(v != F.floor(v), "value must be a whole number")
    error = error.when(~v.between(F.lit(str(low)).cast(values.DECIMAL), F.lit(str(high)).cast(values.DECIMAL)), f"value is outside the reasonable range {low}-{high}")
    return outcome(plain(v), error, [parsed["note"]], v)


@register_validator("regex")
def regex(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    t = strip(raw)
    if params.get("strip"):
        t = F.regexp_replace(t, "(?U)" + params["strip"], "")
    if params.get("upper"):
        t = F.upper(t)
    return let(t, lambda x: _regex(x, raw, kind, params))


def _regex(t: Column, raw: Column, kind: Column, params: dict) -> Column:
    hit = F.lit(False)
    for pattern in params.get("patterns", ()):
        hit = hit | t.rlike(rf"(?U)\A(?:{pattern})\z")
    if params.get("unique_chars"):
        letters = F.split(t, "")
        hit = hit & (F.size(F.array_distinct(letters)) == F.size(letters))
    error = F.when(~kind.isin("string", "int"), F.lit("value must be text or an integer")).when(hit, _null())
    for hint in params.get("hints", ()):
        error = error.when(t.rlike(rf"(?U)\A(?:{hint['pattern']})\z"), hint["message"])
    default = F.lit(params["message"]) if "message" in params else said("'", raw, "' does not match the expected format")
    return outcome(t, error.otherwise(default))


@register_validator("vocabulary")
def vocabulary(raw: Column, kind: Column, params: dict, scope: Scope) -> Column:
    """The best term of each distinct value is looked up beforehand (``scope.vocabulary_match``)."""
    name = params["vocabulary"]
    best = scope.vocabulary_match(raw, name)  # struct(term, score, first)
    found = best["score"] >= scope.settings.get("vocabulary_threshold", 0.75)
    unknown = said("'", raw, f"' is not a recognised {name} value")
    error = F.when(kind != "string", "value must be text").when(best["first"].isNull(), "value is empty")
    if params.get("strict"):
        error = error.when(~found, unknown)
    return outcome(F.when(found, best["term"]).otherwise(best["first"]), error, [F.when(~found, F.concat(unknown, F.lit("; defaults apply")))])
