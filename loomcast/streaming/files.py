"""Transform files as they arrive.

A schema must be forced: choosing one needs the whole dataset.  Each file is
one source; everything after the choice works record by record, so a
micro-batch gives the same rows as one batch run over the same files.  Ranking
windows over records are not allowed on streams, hence ``foreachBatch``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomcast.plans.engine import hints_of, prepare, transform_cells
from loomcast.plans.store import passing, ship
from loomcast.sources.readers import parse_contents

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def transform_stream(
    spark: SparkSession, folder: str, configs, schema: str, results: str, checkpoint: str, fmt: str | None = None,
    languages: Sequence[str] | None = None, settings: dict | None = None, today: datetime.date | None = None,
    trigger: dict | None = None, each: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Add the result rows of new files under ``folder`` to the Parquet table ``results``.

    The batch id is a partition, and a batch that is replayed after a failure overwrites its own.
    """
    ship(spark)
    cfgs = prepare(configs, settings, languages)
    day = today or datetime.date.today()

    def run(batch: DataFrame, batch_id: int) -> None:
        with passing(spark):  # a batch's tables go once its rows are written
            cells = parse_contents(batch.select("path", "content"), fmt, None, hints_of(cfgs))
            report = transform_cells(cells, cfgs, schema, languages, day)
            out = report.results.withColumn("batch_id", F.lit(batch_id))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(results)
            if each:
                each(out, batch_id)

    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Monitoring: events by type in tumbling windows of ``ts``, late rows dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
