"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session has none (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PART: ContextVar[str] = ContextVar("part", default="loomcast")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_PART.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is kept inside goes when the block ends; results have to be written by then."""
    part = f"loomcast/part-{uuid.uuid4().hex}"
    before = _PART.set(part)
    try:
        yield
    finally:
        _PART.reset(before)
        _delete(spark, part)


def _table_name(part: str) -> str:
    return re.sub(r"\W", "_", part)


def _delete(spark: SparkSession, part: str) -> None:
    for t in spark.catalog.listTables(pattern=f"{_table_name(part)}_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{part}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: short plans above it, and nothing to recompute when executors go."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, keys: list[str], deal: bool = False) -> DataFrame:
    """``keep`` in buckets of ``keys``: joins, groups and windows above that hold these keys move nothing.

    ``deal`` sends the rows to their buckets first; what was read from such a table is in place already.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    table = f"{_table_name(_PART.get())}_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys) if deal else df).write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Delete what this library has stored in the session's shared folder; call it when results are written."""
    _delete(spark, "loomcast")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_loomcast_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loomcast-ship-")) / "loomcast_ship.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(target))
    context._loomcast_shipped = True
