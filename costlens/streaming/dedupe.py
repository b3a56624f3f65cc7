"""Arriving billing events, each kept once, whatever is delivered again.

Two things repeat in practice: a producer sends an event or a file again, and a
micro-batch runs again after a failure. The first is met by a state store of event
ids (``dropDuplicatesWithinWatermark``). Its watermark runs on the time of arrival
and not on that of the event, so an event is never too late to be taken, and an id
is remembered for ``remember`` after it came. The second is met by the sink: a
micro-batch is a partition of the table by the stream's run (as long as its
checkpoint lives) and the batch's number, and a batch that runs again replaces
its partition. Within the batch, ids
are also checked against the table itself, so an event that comes again after its
id was forgotten, or to a stream whose checkpoint is lost, still changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.sources.files import read_optional

TENANT, STREAM, BATCH, ID = "organization_id", "ingest_stream", "ingest_batch", "event_id"


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name not in (TENANT, STREAM, BATCH)], T.StructField(TENANT, T.StringType()),
                         T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())])


def unseen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids``. The table's ids grow with it, so
    they are never gathered in the driver for a broadcast."""
    return rows.dropDuplicates([ID]).join(ids.hint("merge"), ID, "left_anti")


def write_batch(rows: DataFrame, number: int, path: str, stream: str) -> None:
    """One micro-batch: the events that no other batch of the table holds. Run
    again with the same number it gives the same partition."""
    seen = read_optional(rows.sparkSession, path, _stored(rows.schema))
    others = seen.where(~((F.col(STREAM) == stream) & (F.col(BATCH) == number))).select(ID)
    (unseen(rows, others).withColumn(STREAM, F.lit(stream)).withColumn(BATCH, F.lit(number).cast("long"))
     .write.partitionBy(TENANT, STREAM, BATCH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint: batch numbers start again with
    a new one, and must not replace the batches of the one that is lost."""
    path = f"{checkpoint.rstrip('/')}/run"
    names = read_optional(spark, path, T.StructType([T.StructField("run", T.StringType())])).collect()
    if not names:
        names = [(uuid.uuid4().hex[:12],)]
        spark.createDataFrame(names, "run string").coalesce(1).write.mode("overwrite").parquet(path)
    return names[0][0]


def stream_events(spark: SparkSession, source_dir: str, schema: T.StructType, normalise: Callable[[DataFrame], DataFrame],
                  tenant: str, path: str, checkpoint: str, stream: str, remember: str = "7 days",
                  max_files_per_trigger: int = 1) -> None:
    """Run until every available file is committed. ``normalise`` turns the
    files' rows, which have an ``event_id``, into canonical ones that keep it."""
    name = f"{stream}-{_run_of(spark, checkpoint)}"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    once = (src.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
            .dropDuplicatesWithinWatermark([ID]))
    rows = normalise(once.drop("_arrived")).withColumn(TENANT, F.lit(tenant))
    q = (rows.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path, name))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(STREAM, BATCH)
