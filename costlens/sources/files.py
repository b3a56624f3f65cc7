"""File sources and sinks.

* CSV billing exports are read with an explicit schema (no inference) and
  the CSV null tokens a billing export uses are turned into nulls.
* The serving tables are Parquet datasets partitioned by tenant, so a
  tenant-scoped read prunes partitions and pushes the remaining predicates
  into the scan. Appends add files (no driver round trip, no row batches);
  ``mode='replace_partition'`` rewrites only the partitions present in the
  batch (dynamic partition overwrite), which makes a rerun idempotent.
* Scratch output goes under the session's checkpoint folder (the shared
  folder the cluster names), never a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costlens.functions import columns as C
from costlens.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/costlens-scratch/{uuid.uuid4().hex}/{name}"


def read_billing_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: headered CSV with a fixed schema; NA-style tokens become null.
    A missing path fails at analysis time (PATH_NOT_FOUND, A2)."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("escape", '"').csv(path))
    return df.select(*[
        (C.na_to_null(df[f"`{f.name}`"]) if isinstance(f.dataType, T.StringType) else df[f"`{f.name}`"])
        .alias(f.name) for f in schema.fields])


def write_billing_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str) -> DataFrame:
    """A5: overwrite a stage output as Parquet and return the read-back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tenant_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append (faithful: a rerun duplicates rows) or replace the
    batch's tenant partitions only."""
    w = df.write.partitionBy("organization_id")
    if mode == "replace_partition":
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.parquet(path)


def read_tenant_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A3: a missing optional input is an empty typed frame, not an error."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
