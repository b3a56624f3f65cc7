"""Explicit schemas (no inference anywhere)."""

from pyspark.sql import types as T

S = ["cloud_provider", "unified_category"]          # a stream

RAW_AWS = T.StructType([
    T.StructField("lineItem/UsageStartDate", T.StringType()),
    T.StructField("productCode", T.StringType()),
    T.StructField("lineItem/UnblendedCost", T.DoubleType()),
    T.StructField("lineItem/NetUnblendedCost", T.DoubleType()),
    T.StructField("resourceTags/user:Environment", T.StringType()),
    T.StructField("resourceTags/user:Team", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_type", T.StringType()),
])

RAW_GCP = T.StructType([
    T.StructField("usage_start_time", T.StringType()),
    T.StructField("service/description", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("labels/env", T.StringType()),
    T.StructField("labels/owner", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_type", T.StringType()),
])

RAW_AZURE = T.StructType([
    T.StructField("UsageDateTime", T.StringType()),
    T.StructField("MeterCategory", T.StringType()),
    T.StructField("CostInBillingCurrency", T.DoubleType()),
    T.StructField("Tags", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_type", T.StringType()),
])

SPEND_COLUMNS = ["timestamp", "cloud_provider", "unified_category", "cost",
                 "normalized_env", "normalized_team", "is_anomaly", "anomaly_type"]

SPEND = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("cloud_provider", T.StringType()),
    T.StructField("unified_category", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("normalized_env", T.StringType()),
    T.StructField("normalized_team", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_type", T.StringType()),
])

CLOUD_SPEND = T.StructType([T.StructField("organization_id", T.StringType())] + SPEND.fields)

CLOUD_FORECAST = T.StructType([
    T.StructField("organization_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("cloud_provider", T.StringType()),
    T.StructField("unified_category", T.StringType()),
    T.StructField("predicted_cost", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("model_used", T.StringType()),
])

ORGANIZATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])
