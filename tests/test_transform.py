import datetime
import json

import pytest

from loomcast import ConfigError, register_rule, transform
from loomcast.__main__ import main

TODAY = datetime.date(2026, 9, 28)
#: An orchard's intake slips: who delivered, and crates with what they weighed and were paid.
INTAKE = {
    "schema_name": "intake", "languages": ["en", "fr"], "csv": {"layout": "lines"},
    "line_containers": ["crates"], "discriminator": {"aliases": ["slip type"], "values": ["intake"]},
    "vocabularies": {"fruit": {"plum": {"aliases": ["damson"], "ceiling": 40}, "pear": {"aliases": [], "ceiling": 90}}},
    "document_fields": {
        "grower": {"validator": "text"},
        "gate": {"validator": "text", "required": False},
        "slip_code": {"validator": "identifier", "required": False, "warn_if_missing": True},
        "total_amount": {"validator": "money", "required": False, "aliases": ["sum due"]},
    },
    "line_fields": {
        "variety": {"validator": "text", "signature": True},
        "paid": {"validator": "money", "signature": True, "sums_to_total": True, "total_equivalent": True, "weak_aliases": ["amount"], "i18n": {"fr": {"aliases": ["verse"]}}},
        "weight": {"validator": "number", "required": False},
        "picked": {"validator": "date", "required": False, "inherit": True},
    },
    "abbreviation_rules": [{"abbreviation": "wt", "expansion": "weight", "confidence": 0.7}, {"abbreviation": "gt", "expansion": "gate", "confidence": 0.6}],
    "rules": [{"kind": "max_by_vocabulary", "amount_field": "paid", "type_field": "variety", "vocabulary": "fruit", "attribute": "ceiling", "default": 70}],
}


def slip(crates, **more):
    return {"grower": "Hill Farm", "crates": crates, **more}


PLUMS = {"variety": "damson", "paid": "32.50", "weight": 18.2}
PEARS = {"variety": "pear", "paid": 80}


def sources(spark, items, configs=(INTAKE,), **more):
    """All items as sources of one run: results by source, and headers."""
    from loomcast.plans.store import ship

    ship(spark)
    texts = [x if isinstance(x, str) else json.dumps(x) for x in items]
    report = transform(spark, texts, list(configs), today=TODAY, **more)
    rows = {}
    for r in report.results.orderBy("rec").collect():
        rows.setdefault(int(r.source_id.split("-")[1]), []).append(r)
    return rows, {int(h.source_id.split("-")[1]): h for h in report.header.collect()}


#: name -> source.
CASES = {
    "plain": slip([PLUMS, PEARS]),
    "no crates": slip([], **{"slip type": "intake"}),
    "crates as text": slip("two crates", **{"slip type": "intake"}),
    "crate as number": slip([7], **{"slip type": "intake"}),
    "two lists": slip([PLUMS], items=[PEARS], **{"slip type": "intake"}),
    "crate at the top": {"grower": "Hill Farm", **PEARS},
    "wrong sum": slip([PLUMS, PEARS], total_amount="112.51"),
    "right sum": slip([PLUMS, PEARS], **{"sum due": "$112.50"}),
    "two records": [slip([PLUMS]), "not a slip"],
    "other type": slip([PLUMS], **{"slip type": "balloon"}),
    "dear plums": slip([{"variety": "plum", "paid": 41}]),
    "dear quinces": slip([{"variety": "quince", "paid": 70.01}]),
    "French sums": slip([{"variety": "pear", "verse": "1 085,75 $"}]),
    "bad values": slip([{"paid": "-4", "colour": "red"}], grower=" "),
    "table": "slip type;grower;gate;variety;paid\nintake;Hill Farm;North;plum;12\nintake;Hill Farm;South;pear;15\n",
    "nothing known": {"colour": "red", "mood": "good"},
    "date above": slip([PLUMS], picked="2026-08-30"),
    "amount above": slip([PLUMS], paid="32.50"),
    "short words": slip([{"variety": "plum", "paid": 1, "wt": 2}], gt="North"),
}


@pytest.fixture(scope="module")
def many(spark):
    rows, heads = sources(spark, list(CASES.values()))
    return {name: (rows.get(k, []), heads.get(k)) for k, name in enumerate(CASES)}


def told(many, name, part="errors"):
    return " | ".join(m for r in many[name][0] for m in r[part])


def output(many, name):
    return json.loads(many[name][0][0].normalized)


def test_documents(many):
    (r,), head = many["plain"]
    assert r.is_valid and head.is_valid and "inferred 'intake'" in head.warnings[0] and "'slip_code' was not provided" in r.warnings
    assert output(many, "plain") == {
        "schema": "intake", "fields": {"grower": "Hill Farm"},
        "lines": [{"variety": "damson", "paid": 32.5, "weight": 18.2}, {"variety": "pear", "paid": 80}],
    }


@pytest.mark.parametrize(("name", "says"), [
    ("no crates", "list of line items is empty"), ("crates as text", "must be an array"), ("crate as number", "line 1 must be an object"), ("two lists", "multiple line-item containers"),
])
def test_line_containers(many, name, says):
    assert says in told(many, name)


def test_a_record_can_be_its_own_line(many):
    assert many["crate at the top"][0][0].is_valid and output(many, "crate at the top")["lines"] == [{"variety": "pear", "paid": 80}]


def test_totals(many):
    assert "total_amount 112.51 does not equal the sum of the line items 112.50" in told(many, "wrong sum") and not many["wrong sum"][1].is_valid
    assert many["right sum"][0][0].is_valid and output(many, "right sum")["fields"]["total_amount"] == 112.5


def test_limits_by_kind(many):
    assert all("exceeds the reasonable maximum" in told(many, name, "errors") + told(many, name, "warnings") for name in ("dear plums", "dear quinces"))
    assert "exceeds" not in told(many, "plain") + told(many, "plain", "warnings")


def test_records_and_types(many):
    assert [r.is_valid for r in many["two records"][0]] == [True, False] and "must be an object" in told(many, "two records")
    assert not many["other type"][0] and "matches no candidate schema" in many["other type"][1].errors[0]
    assert "similar enough" in many["nothing known"][1].errors[0]


def test_languages_choose_the_number_format(many):
    r = many["French sums"][0][0]
    assert r.number_locale == "fr" and list(r.languages_detected) == ["fr"] and output(many, "French sums")["lines"][0]["paid"] == 1085.75


def test_bad_values_are_reported(many):
    errors = told(many, "bad values")
    assert "grower ('grower') is empty" in errors and "negative" in errors
    assert "line 1: required field 'variety' is missing (unrecognised keys on this line: colour)" in errors and output(many, "bad values")["fields"] == {"grower": None}


def test_csv_rows_fold_into_one_document(many):
    assert many["table"][0][0].is_valid and output(many, "table")["fields"] == {"grower": "Hill Farm"}
    assert [(x["gate"], x["paid"]) for x in output(many, "table")["lines"]] == [("North", 12), ("South", 15)]


def test_top_level_line_values_beside_a_list(many):
    assert "not applied" in told(many, "date above", "warnings") and "not applied" in told(many, "amount above", "warnings")


def test_unsure_abbreviations_are_told_with_their_place(many):
    said = many["short words"][0][0].warnings
    assert "gt: abbreviation 'gt' was interpreted as 'gate' (60% confidence)" in said
    assert "crates[1].wt: abbreviation 'wt' was interpreted as 'weight' (70% confidence)" in said


def test_competing_phones_numbers_and_terms(spark):
    from loomcast.plans import engine
    from loomcast.plans.config import Words, build_schema_config

    cfg = build_schema_config({
        "schema_name": "s", "vocabularies": {"fruit": {"plum": {"aliases": ["damson"]}}},
        "document_fields": {"call": {"validator": "phone"}, "n": {"validator": "number", "params": {"maximum": 9}}, "kind": {"validator": "vocabulary", "params": {"vocabulary": "fruit"}}}})
    pairs = [("call", "(555) 123-4567", "555.123.4567", True), ("call", "12", "12", False), ("n", "5", "5.0", True), ("n", "50", "50", False), ("kind", "Damson", "plum", True), ("kind", "plum", "leek", False)]
    rows = [("s", k, "doc", None, 0, f"k{k}", "w", a, b, "string", "string", f, "en", None, None, "competing") for k, (f, a, b, _) in enumerate(pairs)]
    columns = "source_id string, rec bigint, scope string, line int, ord int, key string, winner_key string, text string, winner_text string, kind string, winner_kind string, field string, locale string, language string, winner_language string, role string"
    got = {r.rec: "repeats" in r.message for r in engine.competing_findings(spark.createDataFrame(rows, columns), cfg, Words(cfg)).collect()}
    assert got == {k: same for k, (_, _, _, same) in enumerate(pairs)}


def test_text_that_is_no_path(spark, tmp_path):
    from loomcast.plans.engine import is_path

    (tmp_path / "a.json").write_text("{}")
    assert is_path(spark, str(tmp_path / "a.json")) and is_path(spark, str(tmp_path / "*.json"))
    assert not any(is_path(spark, t) for t in ("a,b", '{"a": 1}', "", "x:y:z", "x" * 5000, str(tmp_path / "b.json")))


def test_settings_inherit_and_total(spark):
    items = [CASES["date above"], CASES["amount above"], slip([PLUMS], paid="33")]
    rows, _ = sources(spark, items, settings={"inherit_shared_fields": True, "interpret_root_amount_as_total": True})
    assert json.loads(rows[0][0].normalized)["lines"][0]["picked"] == "2026-08-30"
    assert rows[1][0].is_valid and json.loads(rows[1][0].normalized)["fields"]["total_amount"] == 32.5 and not rows[2][0].is_valid


def test_two_schemas_and_target_schema(spark):
    member = {"schema_name": "member", "document_fields": {"called": {"validator": "person_name", "signature": True}, "badge": {"validator": "regex", "signature": True, "params": {"patterns": [r"[A-Z]{2}-\d+"]}}},
              "discriminator": {"values": ["member"], "aliases": ["slip type"]}, "target_schema": {"type": "object", "properties": {"fields": {"type": "object", "properties": {"badge": {"type": "string", "pattern": "7$"}}}}}}
    rows, head = sources(spark, [{"Called": "Ruth Okoro", "Badge": "KV-117"}, {"Called": "Ruth Okoro", "Badge": "KV-118"}, CASES["plain"]], (INTAKE, member))
    assert head[0].schema == "member" and rows[0][0].is_valid and "target schema" in rows[1][0].errors[0] and head[2].schema == "intake"


def test_custom_rule_and_unknown_names(spark):
    from pyspark.sql import functions as F

    @register_rule("closed_farms")
    def closed_farms(doc_values, line_values, rule, cfg):
        return doc_values.where("field = 'grower' and out.value = 'Hill Farm'").select("source_id", "rec", F.lit("error").alias("severity"), F.lit("that farm is closed").alias("message"))

    rows, _ = sources(spark, [CASES["plain"]], ({**INTAKE, "rules": [{"kind": "custom", "name": "closed_farms"}]},))
    assert rows[0][0].errors == ["that farm is closed"]
    with pytest.raises(ConfigError):
        transform(spark, CASES["plain"], [INTAKE], schema="nope", today=TODAY)
    with pytest.raises(ConfigError):
        transform(spark, CASES["plain"], [INTAKE], settings={"bogus": 1}, today=TODAY)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(INTAKE))
    (tmp_path / "d.json").write_text(json.dumps(CASES["plain"]))
    assert main([str(tmp_path / "d.json"), "-c", str(tmp_path / "c.json"), "--today", "2026-09-28"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["normalized"]["fields"]["grower"] == "Hill Farm"
    (tmp_path / "c.json").write_text("{}")
    assert main([str(tmp_path / "d.json"), "-c", str(tmp_path / "c.json")]) == 2


def test_stream_gives_the_rows_of_a_batch(spark, tmp_path):
    from loomcast.streaming.files import transform_stream

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(CASES["plain"]))
    transform_stream(spark, str(tmp_path / "in"), [INTAKE], "intake", str(tmp_path / "out"), str(tmp_path / "ck"), today=TODAY).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("is_valid").count() == 2


def test_header_gathers_no_source_whole(spark):
    from pyspark.sql import functions as F

    from loomcast.operators import detect
    from loomcast.plans import engine

    records = spark.range(1, 1001).select(F.concat(F.lit("s"), F.col("id") % 1).alias("source_id"), F.col("id").cast("int").alias("rec"), F.lit("unrecognised").alias("status"))
    got = detect.first_records(records, "unrecognised", F.concat(F.lit("r"), F.col("rec")), "unknown")
    assert [x.rec for x in got.head().unknown] == list(range(1, 11))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    results = spark.createDataFrame([("s", ["fr", "en"]), ("s", ["en"]), ("t", [])], "source_id string, languages_detected array<string>")
    seen = engine.languages_of(results)
    assert [tuple(r) for r in seen.collect()] == [("s", ["en", "fr"])]
    assert "collect_list" not in seen._jdf.queryExecution().executedPlan().toString()
