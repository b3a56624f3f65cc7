"""K1: arriving billing events appended to the tenant spend table with
Structured Streaming.

A file source (``readStream`` with an explicit schema) picks up new export
files; each micro-batch is normalised with the same column expressions as
the batch path and appended to the tenant-partitioned Parquet table. The
checkpoint records which files were committed, so a restart after a lost
executor or driver neither skips nor duplicates a file. The operator is
stateless, so no watermark or state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators import normalize as N
from costlens.sources.tables import events_as_azure


def stream_append(spark: SparkSession, source_dir: str, schema: T.StructType, tenant: str,
                  sink_dir: str, checkpoint: str, max_files_per_trigger: int = 1) -> None:
    """Run the append stream until every available file is committed."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    out = N.normalize_azure(events_as_azure(src)).withColumn("organization_id", F.lit(tenant))
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy("organization_id")
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
