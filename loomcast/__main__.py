"""``python -m loomcast SOURCE --config FILE``: transform a source and print the report as JSON.

Exit code 0: valid; 1: not valid; 2: the configuration cannot be used.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from loomcast.plans.config import ConfigError, SourceError
from loomcast.plans.engine import Report, transform
from loomcast.plans.store import keep


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomcast")
    p.add_argument("source")
    p.add_argument("--config", "-c", action="append", required=True)
    p.add_argument("--format", choices=("json", "xml", "csv"))
    p.add_argument("--schema")
    p.add_argument("--languages", help="comma-separated")
    p.add_argument("--csv-delimiter")
    p.add_argument("--output", help="folder for the report as JSON lines, instead of printing it")
    p.add_argument("--today", type=datetime.date.fromisoformat)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        languages = a.languages.split(",") if a.languages else None
        report = transform(spark, a.source, a.config, a.format, a.schema, languages, None, a.csv_delimiter, a.today)
    except (ConfigError, SourceError) as e:
        print(f"configuration error: {e}", file=sys.stderr)
        return 2
    report = replace(report, header=keep(report.header, "report"))
    if a.output:
        report.write(a.output)
    else:
        printed(report)
    return 0 if report.is_valid() else 1


def printed(report: Report) -> None:
    """Print the report as one JSON object; rows arrive a partition at a time, so the driver holds no more than that."""

    def each(df, change=lambda row: row):
        for k, r in enumerate(df.toLocalIterator()):
            print(",\n" if k else "\n", json.dumps(change(r.asDict(True)), indent=2, ensure_ascii=False, default=str), sep="", end="")

    def opened(row: dict) -> dict:
        return row | {"normalized": json.loads(row["normalized"]) if row["normalized"] else None}

    print('{"sources": [', end="")
    each(report.header.orderBy("source_id"))
    print('],\n"results": [', end="")
    each(report.results.orderBy("source_id", "rec"), opened)
    print("]}")


if __name__ == "__main__":
    sys.exit(main())
