"""Vendor exports -> canonical spend (B1-B3) and their union (H1).

Each normaliser is one ``select``: no Python, no UDF, so the projection
fuses into the scan's whole-stage codegen. JSON tags use Spark's JSON
functions (``json_object_keys`` tells a missing key from a JSON null).
``keep`` names columns that stay as they are, such as an event's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.schema import SPEND_COLUMNS


def _q(name: str):
    return F.col(f"`{name}`")


def normalize_aws(raw: DataFrame, *keep: str) -> DataFrame:
    """B1: cost is the unblended cost (net cost is ignored)."""
    return raw.select(
        *keep,
        C.parse_ts(_q("lineItem/UsageStartDate")).alias("timestamp"),
        F.lit("AWS").alias("cloud_provider"),
        C.category_map(_q("productCode"), fixed.AWS_SERVICE_MAP).alias("unified_category"),
        _q("lineItem/UnblendedCost").cast("double").alias("cost"),
        C.lower_fill(_q("resourceTags/user:Environment")).alias("normalized_env"),
        C.lower_fill(_q("resourceTags/user:Team")).alias("normalized_team"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.col("anomaly_type"),
    )


def normalize_gcp(raw: DataFrame, *keep: str) -> DataFrame:
    """B2."""
    return raw.select(
        *keep,
        C.parse_ts(_q("usage_start_time")).alias("timestamp"),
        F.lit("GCP").alias("cloud_provider"),
        C.category_map(_q("service/description"), fixed.GCP_SERVICE_MAP).alias("unified_category"),
        _q("cost").cast("double").alias("cost"),
        C.lower_fill(_q("labels/env")).alias("normalized_env"),
        C.lower_fill(_q("labels/owner")).alias("normalized_team"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.col("anomaly_type"),
    )


def normalize_azure(raw: DataFrame, *keep: str) -> DataFrame:
    """Env and team come from the JSON ``Tags`` string."""
    return raw.select(
        *keep,
        C.parse_ts(_q("UsageDateTime")).alias("timestamp"),
        F.lit("Azure").alias("cloud_provider"),
        C.category_map(_q("MeterCategory"), fixed.AZURE_SERVICE_MAP).alias("unified_category"),
        _q("CostInBillingCurrency").cast("double").alias("cost"),
        C.json_tag(_q("Tags"), "env").alias("normalized_env"),
        C.json_tag(_q("Tags"), "team").alias("normalized_team"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.col("anomaly_type"),
    )


def union_clouds(*frames: DataFrame) -> DataFrame:
    """H1: bag union by column name (no dedup, no sort: ordering is left to
    the consumers that need it, which all sort on explicit keys)."""
    out = frames[0].select(*SPEND_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*SPEND_COLUMNS))
    return out
