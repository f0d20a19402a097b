"""The registered queries, and what they share."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.plans.store import ship

TODAY = datetime.date(2002, 1, 1)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


# ---- shared fragments of the oracles -------------------------------------------------------------------------
#: amounts in text, built from whole cents so that no engine's float printing matters
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def cents_of(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def whole(c):
    return F.expr(f"{c} div 100").cast("string")


def frac(c):
    return F.lpad(F.expr(f"{c} % 100").cast("string"), 2, "0")
