"""Kinds of sources, sources without usable records, and tables of which a row is bad."""

import datetime
import json

import pytest

from loomcast import SourceError, transform
from tests.test_transform import INTAKE, PLUMS, slip

TODAY = datetime.date(2026, 9, 28)
TABLE = "slip type,grower,variety,paid\nintake,Hill Farm,damson,12\nintake,Hill Farm,pear,15\n"
ODD = {
    "good table": TABLE,
    "clash": "slip type,p.q,p > q\nintake,1,2\nintake,3,4\n",
    "no fit": "colour,shape\nred,round\nblue,square\n",
    "all bad": "[1, [2], {}]",
    "some bad": json.dumps([1, slip([PLUMS])]),
    "nothing": "[]",
    "bytes": bytearray(json.dumps(slip([PLUMS])).encode()),
}


@pytest.fixture(scope="module")
def odd(spark):
    from loomcast.plans.store import ship

    ship(spark)
    report = transform(spark, list(ODD.values()), [INTAKE], today=TODAY)
    names = list(ODD)
    heads = {names[int(h.source_id.split("-")[1])]: h for h in report.header.collect()}
    rows = {}
    for r in report.results.orderBy("rec").collect():
        rows.setdefault(names[int(r.source_id.split("-")[1])], []).append(r)
    return heads, rows


def test_usable_sources(odd):
    heads, rows = odd
    assert heads["good table"].n_records == 1 and rows["good table"][0].is_valid
    assert heads["bytes"].is_valid and len(rows["bytes"]) == 1
    assert [r.is_valid for r in rows["some bad"]] == [False, True] and rows["some bad"][0].errors == ["record must be an object"]


def test_sources_without_a_usable_record(odd):
    heads, rows = odd
    assert heads["all bad"].errors == ["record must be an object; record must be an object; record is empty"]
    assert heads["nothing"].errors == ["no usable records"]
    assert "conflicting flattened paths" in heads["clash"].errors[0]
    assert not {"all bad", "nothing", "clash"} & rows.keys()
    assert not any(heads[n].is_valid for n in ("all bad", "nothing", "clash"))


def test_a_bad_row_bars_the_table(spark):
    from loomcast.sources.readers import CELLS

    columns = ("slip type", "grower", "variety", "paid")
    good = [("intake", "Hill Farm", "damson", "12"), ("intake", "Hill Farm", "pear", "15")]

    def cells(name, rows):
        for rec, row in enumerate(rows, 1):
            if isinstance(row, str):
                yield name, "csv", rec, None, 0, None, None, "record_error", row
            else:
                yield from ((name, "csv", rec, None, k, None, c, "string", v) for k, (c, v) in enumerate(zip(columns, row, strict=False)))

    tables = {"fine": good, "barred": [*good, "row is torn", good[0], "row is lost"], "strange": [*good, ("", "", "")]}
    frame = spark.createDataFrame([c for name, rows in tables.items() for c in cells(name, rows)], CELLS)
    report = transform(spark, frame, [INTAKE], today=TODAY)
    heads = {h.source_id: h for h in report.header.collect()}
    assert {r.source_id for r in report.results.collect()} == {"fine"} | ({"strange"} if not heads["strange"].errors else set())
    assert heads["barred"].errors == ["CSV rows cannot be combined into one document: row 3: row is torn; row 5: row is lost"]
    assert not heads["barred"].is_valid and heads["barred"].n_records == 0 and heads["fine"].is_valid


def test_spelt_out_is_bounded(spark):
    from loomcast.plans.engine import SPELT_OUT, spelt_out

    rows = spark.range(1, 251).selectExpr("'s' as source_id", "id as rec", "concat('row ', id) as message")
    said = spelt_out(rows).head().said
    assert said.startswith("row 1; row 2; ") and said.endswith(f"row {SPELT_OUT}; and {250 - SPELT_OUT} more")


def test_reports_name_every_bad_row(spark):
    from loomcast.sources.readers import CELLS

    torn = [("barred", "csv", rec, None, 0, None, None, "record_error", "row is torn") for rec in range(2, 252)]
    idle = [("idle", *c[1:]) for c in torn]
    fine = [("barred", "csv", 1, None, k, None, c, "string", v) for k, (c, v) in enumerate((("slip type", "intake"), ("grower", "Hill Farm"), ("variety", "damson"), ("paid", "12")))]
    heads = {h.source_id: h.errors for h in transform(spark, spark.createDataFrame(torn + idle + fine, CELLS), [INTAKE], today=TODAY).header.collect()}
    assert heads["barred"] == ["CSV rows cannot be combined into one document: " + "; ".join(f"row {rec}: row is torn" for rec in range(2, 252))]
    assert heads["idle"] == ["; ".join(["row is torn"] * 250)]


def test_paths_and_formats(spark, tmp_path):
    (tmp_path / "a.data").write_text(TABLE)
    for source, fmt in ((tmp_path / "a.data", "CSV"), (str(tmp_path / "a.data"), " Csv ")):
        report = transform(spark, source, [INTAKE], fmt=fmt, today=TODAY)
        assert [r.is_valid for r in report.results.collect()] == [True]
    for source, fmt in ((tmp_path / "none.csv", None), (3.5, None), ({"a": 1}, "csv"), (TABLE, "yaml")):
        with pytest.raises(SourceError):
            transform(spark, source, [INTAKE], fmt=fmt, today=TODAY)


def test_a_large_table_equals_a_small_one(spark, tmp_path):
    body = "".join(f"intake,Hill Farm,{v},{p}\n" for v, p in [("damson", 12), ("pear", 15)] * 400)
    (tmp_path / "a.csv").write_text("slip type,grower,variety,paid\n" + body)
    told = []
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            report = transform(spark, tmp_path / "a.csv", [INTAKE], today=TODAY)
            told.append([r.asDict(True) for r in report.results.collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert told[0] == told[1] and len(json.loads(told[0][0]["normalized"])["lines"]) == 800


def test_record_rules_and_the_written_report(spark, tmp_path):
    from loomcast import register_record_rule
    from loomcast.__main__ import main

    @register_record_rule("light_crates")
    def light_crates(doc, lines, rule):
        for n, line in enumerate(lines, 1):
            if line.get("weight") is not None and line["weight"] < rule["least"]:
                yield "error", f"line {n}: {line['variety']} of {doc['grower']} weighs only {line['weight']}"
        if len(lines) > 1:
            yield "warning", f"{len(lines)} crates"

    config = {**INTAKE, "rules": [{"kind": "custom", "name": "light_crates", "least": 15}]}
    light = {"variety": "pear", "paid": 80, "weight": "9.5"}
    for name, crates in (("a", [PLUMS]), ("b", [PLUMS, light])):
        (tmp_path / f"{name}.json").write_text(json.dumps(slip(crates)))
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "c.json").write_text(json.dumps(config))
    assert main([str(tmp_path / "*.json"), "-c", str(tmp_path / "conf" / "c.json"), "--today", "2026-09-28", "--output", str(tmp_path / "out")]) == 1
    rows = {r.source_id[-6:]: r for r in spark.read.json(str(tmp_path / "out" / "results")).collect()}
    assert rows["a.json"].is_valid and rows["b.json"].errors == ["line 2: pear of Hill Farm weighs only 9.5"] and "2 crates" in rows["b.json"].warnings
    assert spark.read.json(str(tmp_path / "out" / "header")).count() == 2
    assert spark.read.json(str(tmp_path / "out" / "findings")).where("severity = 'error'").count() == 1


def test_what_is_kept_goes(spark):
    import os

    from loomcast.plans import store

    with store.passing(spark):
        kept = store.keep(spark.range(5), "t")
        folder = store.scratch(spark, "t").rsplit("/", 1)[0].removeprefix("file://")
        assert kept.count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert store.keep(spark.range(5), "t").count() == 5
