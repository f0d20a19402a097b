"""Totals, cross-field rules and the target schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.validators import plain
from loomcast.plans.config import RECORD_RULES, RULES, SchemaConfig
from loomcast.plans.target import violations

RECORD = ["source_id", "rec"]


def _finding(code: str, df: DataFrame, stage: int, seq: Column, severity: str, message: Column) -> DataFrame:
    return df.select(*RECORD, F.lit(stage).alias("stage"), seq.cast("long").alias("seq"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")).where("message is not null")


def _cents(name: str) -> Column:
    """A number with two decimals."""
    return F.col(name).cast("decimal(38,2)").cast("string")


def total_findings(doc_values: DataFrame, line_values: DataFrame, line_ids: DataFrame, cfg: SchemaConfig) -> DataFrame:
    """The document total must equal the exact sum of the line fields that add up to it.

    Skipped without a total, without lines, or where a line lacks the first such field.
    """
    sums = [f.name for f in cfg.line_fields if f.sums_to_total]
    if not sums or not cfg.total_field:
        return doc_values.limit(0).select(*RECORD, F.lit(9).alias("stage"), F.lit(0).cast("long").alias("seq"), F.lit("error").alias("severity"), F.lit("TOTAL").alias("code"), F.lit("").alias("message"))
    per = line_values.where(F.col("field").isin(*sums)).groupBy(*RECORD).agg(
        F.sum("out.number").alias("lines_sum"), F.count(F.when((F.col("field") == sums[0]) & F.col("out.number").isNotNull(), 1)).alias("n_first")
    )
    n = line_ids.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n_lines"))
    total = doc_values.where((F.col("field") == cfg.total_field) & F.col("out.number").isNotNull()).select(*RECORD, F.col("out.number").alias("total"))
    return wrong_totals(total.join(per, RECORD).join(n, RECORD), cfg)


def wrong_totals(sums: DataFrame, cfg: SchemaConfig) -> DataFrame:
    """``sums``: total, lines_sum, n_first (lines with the first field that adds up) and n_lines of each record."""
    wrong = sums.where("n_first = n_lines and total <> lines_sum")
    text = F.concat(F.lit(f"{cfg.total_field} "), _cents("total"), F.lit(" does not equal the sum of the line items "), _cents("lines_sum"))
    return _finding("TOTAL", wrong, 9, F.lit(0), cfg.settings["total_mismatch_severity"], text)


def rule_findings(doc_values: DataFrame, line_values: DataFrame, cfg: SchemaConfig, every: DataFrame) -> list[DataFrame]:
    """Declarative rules look at lines, custom ones at what they like; in the order of the configuration."""
    out = []
    one = lambda name, alias: line_values.where(F.col("field") == name).select(*RECORD, "line", F.col("out").alias(alias))
    for i, rule in enumerate(cfg.rules):
        if rule["kind"] == "custom" and rule["name"] not in RULES:
            continue
        if rule["kind"] == "custom":
            out.append(RULES[rule["name"]](doc_values, line_values, rule, cfg).select(*RECORD, F.lit(10).alias("stage"), F.lit(i * 100000).cast("long").alias("seq"), "severity", F.lit("RULE_CUSTOM").alias("code"), "message"))
            continue
        amount = one(rule["amount_field"], "a").where("a.number is not null")
        seq = F.lit(i * 100000) + F.col("line")
        if rule["kind"] == "max_by_vocabulary":
            doc_type = doc_values.where(F.col("field") == rule["type_field"]).select(*RECORD, F.col("out.value").alias("doc_type"))
            kind = one(rule["type_field"], "t").select(*RECORD, "line", F.col("t.value").alias("line_type"))
            limits = {t: m[rule["attribute"]] for t, m in cfg.vocabularies[rule["vocabulary"]].items() if m.get(rule["attribute"]) is not None}
            # a relation, so that a vocabulary of any size stays out of the plan; Spark broadcasts it where it is small
            table = amount.sparkSession.createDataFrame([(t, float(v)) for t, v in limits.items()], "type string, limit double")
            rows = amount.join(kind, [*RECORD, "line"], "left").join(doc_type, RECORD, "left").withColumn("type", F.coalesce("line_type", "doc_type"))
            rows = rows.join(table, "type", "left").withColumn("most", F.coalesce("limit", F.lit(float(rule["default"])))).where("a.number > most")
            shown = F.coalesce("type", F.lit(f"unknown {rule['type_field']}"))
            text = F.concat(
                F.lit("line "), F.col("line").cast("string"), F.lit(f": {rule['amount_field']} "), _cents("a.number"),
                F.lit(" exceeds the reasonable maximum "), _cents("most"), F.lit(" for '"), shown, F.lit("'"))
            out.append(_finding("RULE_MAX", rows, 10, seq, rule.get("severity", "error"), text))
        else:
            units = one(rule["unit_field"], "u").where("u.number <> 0")
            rows = amount.join(units, [*RECORD, "line"]).where(F.col("a.number") / F.col("u.number") > F.lit(float(rule["max_rate"])))
            text = F.concat(
                F.lit("line "), F.col("line").cast("string"), F.lit(": "), _cents("a.number"), F.lit(" for "), plain(F.col("u.number")),
                F.lit(f" {rule.get('unit_label', 'units')} is an unusually high rate"))
            out.append(_finding("RULE_RATE", rows, 10, seq, "warning", text))
    by_record = [(i, rule) for i, rule in enumerate(cfg.rules) if rule["kind"] == "custom" and rule["name"] not in RULES]
    if by_record:
        out.append(record_rule_findings(doc_values, line_values, by_record, every))
    return out


def record_rule_findings(doc_values: DataFrame, line_values: DataFrame, rules: list[tuple[int, dict]], every: DataFrame) -> DataFrame:
    """What the rules of single records say; all rules see a record in one call of a task, and only its own values are gathered."""
    functions = [(i, rule, RECORD_RULES[rule["name"]]) for i, rule in rules]
    value = lambda df, line: df.select(*RECORD, F.struct(line.alias("line"), "field", F.col("out.value").cast("string").alias("text"), F.col("out.number").alias("number")).alias("v"))
    tall = value(doc_values, F.lit(None).cast("int")).unionByName(value(line_values, F.col("line").cast("int")))
    records = every.select(*RECORD).join(tall.groupBy(*RECORD).agg(F.collect_list("v").alias("values")), RECORD, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc: dict = {}
                lines: dict[int, dict] = {}
                for v in sorted(r["values"] or (), key=lambda v: (v["line"] or 0, v["field"])):
                    own = doc if v["line"] is None else lines.setdefault(v["line"], {})
                    own[v["field"]] = v["text"] if v["number"] is None else v["number"].normalize()
                for i, rule, f in functions:
                    for k, (severity, message) in enumerate(f(dict(doc), [dict(lines[n]) for n in sorted(lines)], rule) or ()):
                        if severity not in ("error", "warning"):
                            raise ValueError(f"rule '{rule['name']}': severity must be 'error' or 'warning', not {severity!r}")
                        rows.append((r["source_id"], r["rec"], 10, i * 100000 + k, severity, "RULE_CUSTOM", str(message)))
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source_id", "rec", "stage", "seq", "severity", "code", "message"])

    return records.mapInArrow(run, "source_id string, rec bigint, stage int, seq long, severity string, code string, message string")


def target_findings(results: DataFrame, findings: DataFrame, cfg: SchemaConfig) -> DataFrame:
    """Violations of the target schema by records that have no error so far."""
    failed = findings.where("severity = 'error'").select(*RECORD).distinct()
    schema = cfg.target

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (s, r, 12, k, "error", "TARGET", f"target schema: {'.'.join(map(str, path)) or '(root)'}: {message}")
                for s, r, text in zip(b["source_id"], b["rec"], b["normalized"], strict=True)
                for k, (path, message) in enumerate(violations(json.loads(text), schema))
            ]
            yield pd.DataFrame(rows, columns=["source_id", "rec", "stage", "seq", "severity", "code", "message"])

    clean = results.select(*RECORD, "normalized").join(failed, RECORD, "left_anti")
    return clean.mapInPandas(run, "source_id string, rec bigint, stage int, seq long, severity string, code string, message string")
