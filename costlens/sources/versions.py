"""Tenant tables whose rows carry the number of the load that wrote them.

A batch (a billing month, a forecast run) may be loaded again: each load is a
partition of its own below its tenant and batch, and readers take the newest load
of every batch. A load is written as a whole or replaced as a whole, so repeating
a load with the same number changes nothing, and a new load never mixes with rows
of an older one, whatever task or job failed in between.

Readers hand in their predicate: tenant, stream and time reach the scan first,
and the newest loads, a table of one row per tenant and batch that is found from
partition folders only, prune the files of all older loads at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators.keyed import join_groups

TENANT, BATCH, LOAD = "organization_id", "load_batch", "load_number"


def write_load(df: DataFrame, path: str, batch: str, number: int) -> None:
    """One load of a batch; the same number again replaces it."""
    (df.withColumn(BATCH, F.lit(batch)).withColumn(LOAD, F.lit(number).cast("int"))
     .write.partitionBy(TENANT, BATCH, LOAD).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_loads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All loads of a table; a missing one is empty. ``schema`` is that of the
    rows without the columns of the load."""
    from costlens.sources.files import read_optional
    names = [T.StructField(BATCH, T.StringType()), T.StructField(LOAD, T.IntegerType())]
    return read_optional(spark, path, T.StructType([*schema.fields, *names]))


def newest(loads: DataFrame, where: Column | None = None, keep_load: bool = False) -> DataFrame:
    """The rows of each tenant's and batch's newest load, under a predicate."""
    rows = loads if where is None else loads.where(where)
    # the newest load is that of the batch, whether or not it has rows of the stream
    last = loads.groupBy(TENANT, BATCH).agg(F.max(LOAD).alias(LOAD))
    # few keys and all rows: dealt by them, a tenant's load would be one task's
    out = join_groups(rows, F.broadcast(last.withColumn("_newest", F.lit(True))), [TENANT, BATCH, LOAD])
    return out.drop("_newest") if keep_load else out.drop("_newest", BATCH, LOAD)


def newest_per_key(loads: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Of rows that batches have in common (a day forecast by several runs), the
    one of the newest load, of equal loads that of the last batch by name."""
    rows = loads if where is None else loads.where(where)
    rest = [c for c in rows.columns if c not in (*keys, LOAD, BATCH)]
    g = rows.groupBy(*keys).agg(F.max(F.struct(LOAD, BATCH, *rest)).alias("_last"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns if c not in (LOAD, BATCH)])
