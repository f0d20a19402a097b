"""Where operators keep intermediate tables, and how they let go of them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (unit tests) a
    temporary folder is made and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomcast/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def buckets(spark: SparkSession, wanted: int) -> int:
    """As many buckets as wanted, at least one for each shuffle partition, at most as many as tables may have."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), most)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Store ``df`` in ``n`` buckets of ``key`` (a file each): later joins on the key do not move it again."""
    spark = df.sparkSession
    table_name, path = f"loomcast_{name}_{uuid.uuid4().hex}", scratch(spark, name)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


def release(spark: SparkSession) -> None:
    """Delete everything that operators of this session have stored; call it when their results are written."""
    folder = f"{shared_dir(spark)}/loomcast"
    for t in spark.catalog.listTables(pattern="loomcast_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    discard(spark, folder)


def snug(df: DataFrame, rows: int, per: int = 500_000) -> DataFrame:
    """As few partitions as ``rows`` need.  Joins and aggregates of tables that fit one partition need no exchange."""
    return df.coalesce(max(1, -(-rows // per)))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
