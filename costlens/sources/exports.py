"""Billing exports as CSV, with a quarantine for records that don't fit.

A record is rejected whole, never in part: a cost such as ``"1,234.50"`` that is no
number, a missing or surplus field, or a time that is no timestamp. Rejected
records keep their text and a reason and are written apart, so that the rows read
and the rows quarantined always add up to the records of the export. An empty
field is no fault: it is null, as are the usual tokens for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import schema as SC
from costlens.functions import columns as C
from costlens.operators import normalize as N
from costlens.session import materialize

CORRUPT = "_record"
REASON = "reason"

#: Schema, time column and normaliser of each vendor's export.
VENDORS = {"aws": (SC.RAW_AWS, "lineItem/UsageStartDate", N.normalize_aws),
           "gcp": (SC.RAW_GCP, "usage_start_time", N.normalize_gcp),
           "azure": (SC.RAW_AZURE, "UsageDateTime", N.normalize_azure)}

QUARANTINE = T.StructType([T.StructField("vendor", T.StringType()), T.StructField(REASON, T.StringType()),
                           T.StructField(CORRUPT, T.StringType())])


def read_export(spark: SparkSession, path: str, vendor: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the vendor's layout, quarantined records). The parsed file is
    written once, so both come from the same parse."""
    schema, when, _ = VENDORS[vendor]
    parsed = (spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
              .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .option("escape", '"').csv(path))
    parsed = parsed.select(*[
        (C.na_to_null(parsed[f"`{f.name}`"]) if isinstance(f.dataType, T.StringType) else parsed[f"`{f.name}`"]).alias(f.name)
        for f in schema.fields], CORRUPT)
    stamp = F.col(f"`{when}`")
    reason = (F.when(F.col(CORRUPT).isNotNull(), "malformed record")
              .when(stamp.isNull(), "no time")
              .when(stamp.try_cast("timestamp_ntz").isNull(), "malformed time"))
    judged = materialize(parsed.withColumn(REASON, reason), f"export-{vendor}")
    good = judged.where(F.col(REASON).isNull()).drop(REASON, CORRUPT)
    text = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    bad = judged.where(F.col(REASON).isNotNull()).select(F.lit(vendor).alias("vendor"), REASON, text.alias(CORRUPT))
    return good, bad


def normalized_exports(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(canonical rows of all vendors, quarantined records of all vendors)."""
    rows, bad = [], []
    for vendor, path in paths.items():
        good, rejected = read_export(spark, path, vendor)
        rows.append(VENDORS[vendor][2](good))
        bad.append(rejected)
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return N.union_clouds(*rows), out
