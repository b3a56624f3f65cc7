"""Driver tables and the billing views derived from them.

The driver ships TPC-H-like Parquet tables. These functions only reshape
them into the schemas the cost operators consume (canonical spend, raw
vendor exports, an event feed); they do none of the operators' work. Each
view reads only the tables and columns it needs, so Catalyst prunes the
scan (``ReadSchema``) and pushes the vendor split into it
(``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens import fixed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


# --- stand-in mapping of driver columns onto billing fields -----------------
# (input shaping only; see FIXTURES.md section 2)

def _provider(returnflag: Column) -> Column:
    return (F.when(returnflag == "A", "AWS").when(returnflag == "N", "GCP")
            .when(returnflag == "R", "Azure"))


def _category_from_type(p_type: Column) -> Column:
    return (F.when(p_type.isin("STANDARD", "ECONOMY"), "COMPUTE")
            .when(p_type.isin("MEDIUM", "SMALL"), "STORAGE")
            .when(p_type == "LARGE", "NETWORK")
            .otherwise(fixed.OTHER_CATEGORY))


def _env(linestatus: Column) -> Column:
    return F.when(linestatus == "F", "prod").when(linestatus == "O", "dev").otherwise(fixed.UNKNOWN)


def _line_items(t: Tables, team: bool, tenant: bool) -> DataFrame:
    """lineitem left-joined to the dimensions a view needs (and no more).

    Dimension chains are joined among themselves first (orders with
    customer, supplier with nation), so the lineitem-sized side is shuffled
    once per chain instead of once per table. The rewrite is exact: an
    equality on the inner key rejects nulls, so
    (L left O) left C = L left (O left C)."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                           "l_extendedprice", "l_discount", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    part = t.part.select("p_partkey", "p_type")
    df = li.join(part, li.l_partkey == part.p_partkey, "left")
    if team:
        orders = t.orders.select("o_orderkey", "o_custkey")
        cust = t.customer.select("c_custkey", "c_mktsegment")
        oc = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
        df = df.join(oc, df.l_orderkey == oc.o_orderkey, "left")
    if tenant:
        supp = t.supplier.select("s_suppkey", "s_nationkey")
        nation = t.nation.select("n_nationkey", "n_regionkey")
        # supplier x nation is dimension-sized; AQE broadcasts it at run
        # time when the measured side is small
        sn = supp.join(nation, supp.s_nationkey == nation.n_nationkey, "left")
        df = df.join(sn, df.l_suppkey == sn.s_suppkey, "left")
    return df


def spend(t: Tables, team: bool = True, tenant: bool = False) -> DataFrame:
    """Canonical spend rows (one per line item).

    ``team`` adds the orders/customer joins behind ``normalized_team`` and
    ``tenant`` the supplier/nation joins behind ``organization_id``; a
    stream-level query that needs neither reads only lineitem and part.
    """
    df = _line_items(t, team, tenant)
    cols = []
    if tenant:
        cols.append(F.concat(F.lit("org-"), F.coalesce(F.col("n_regionkey").cast("string"),
                                                       F.lit(fixed.UNKNOWN))).alias("organization_id"))
    cols += [
        F.col("l_shipdate").alias("timestamp"),
        _provider(F.col("l_returnflag")).alias("cloud_provider"),
        _category_from_type(F.col("p_type")).alias("unified_category"),
        F.col("l_extendedprice").alias("cost"),
        _env(F.col("l_linestatus")).alias("normalized_env"),
        (F.coalesce(F.lower("c_mktsegment"), F.lit(fixed.UNKNOWN)) if team
         else F.lit(fixed.UNKNOWN)).alias("normalized_team"),
        (F.col("l_quantity") >= 49).cast("int").alias("is_anomaly"),
        F.when(F.col("l_quantity") >= 49, "spike").otherwise("none").alias("anomaly_type"),
    ]
    return df.select(*cols)


# --- stand-in raw vendor exports -------------------------------------------

def _vendor_service(p_type: Column, names: dict[str, str]) -> Column:
    """Vendor product name for a part type; PROMO gets a name no map knows."""
    inv = {v: k for k, v in names.items()}
    return (F.when(p_type.isin("STANDARD", "ECONOMY"), inv["COMPUTE"])
            .when(p_type.isin("MEDIUM", "SMALL"), inv["STORAGE"])
            .when(p_type == "LARGE", inv["NETWORK"])
            .otherwise(F.concat(F.lit("Promo "), p_type)))


def _raw_env(linestatus: Column) -> Column:
    # mixed case on purpose: the normaliser lower-cases tags
    return F.when(linestatus == "F", "Prod").when(linestatus == "O", "Dev")


def raw_aws(t: Tables) -> DataFrame:
    df = _line_items(t, team=True, tenant=False).where(F.col("l_returnflag") == "A")
    return df.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("lineItem/UsageStartDate"),
        _vendor_service(F.col("p_type"), fixed.AWS_SERVICE_MAP).alias("productCode"),
        F.col("l_extendedprice").alias("lineItem/UnblendedCost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lineItem/NetUnblendedCost"),
        _raw_env(F.col("l_linestatus")).alias("resourceTags/user:Environment"),
        F.col("c_mktsegment").alias("resourceTags/user:Team"),
        (F.col("l_quantity") >= 49).cast("int").alias("is_anomaly"),
        F.when(F.col("l_quantity") >= 49, "spike").otherwise("none").alias("anomaly_type"),
    )


def raw_gcp(t: Tables) -> DataFrame:
    df = _line_items(t, team=True, tenant=False).where(F.col("l_returnflag") == "N")
    return df.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("usage_start_time"),
        _vendor_service(F.col("p_type"), fixed.GCP_SERVICE_MAP).alias("service/description"),
        F.col("l_extendedprice").alias("cost"),
        _raw_env(F.col("l_linestatus")).alias("labels/env"),
        F.col("c_mktsegment").alias("labels/owner"),
        (F.col("l_quantity") >= 49).cast("int").alias("is_anomaly"),
        F.when(F.col("l_quantity") >= 49, "spike").otherwise("none").alias("anomaly_type"),
    )


def raw_azure(t: Tables) -> DataFrame:
    df = _line_items(t, team=True, tenant=False).where(F.col("l_returnflag") == "R")
    tags = F.to_json(F.struct(_raw_env(F.col("l_linestatus")).alias("env"),
                              F.col("c_mktsegment").alias("team")))
    return df.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("UsageDateTime"),
        _vendor_service(F.col("p_type"), fixed.AZURE_SERVICE_MAP).alias("MeterCategory"),
        F.col("l_extendedprice").alias("CostInBillingCurrency"),
        tags.alias("Tags"),
        (F.col("l_quantity") >= 49).cast("int").alias("is_anomaly"),
        F.when(F.col("l_quantity") >= 49, "spike").otherwise("none").alias("anomaly_type"),
    )


def events_as_azure(events: DataFrame, *keep: str) -> DataFrame:
    """Event rows in the Azure export layout: intraday timestamps and
    free-form JSON tags (``{"k": n}``: no env, no team). Works on a batch or
    a streaming frame; ``keep`` names columns that stay."""
    return events.select(
        *keep,
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UsageDateTime"),
        F.col("event_type").alias("MeterCategory"),
        F.col("value").alias("CostInBillingCurrency"),
        F.col("props").alias("Tags"),
        F.lit(0).alias("is_anomaly"),
        F.lit("none").alias("anomaly_type"),
    )


def raw_azure_events(t: Tables) -> DataFrame:
    """The event table as an Azure-style export."""
    return events_as_azure(t.events)


def event_spend(t: Tables) -> DataFrame:
    """Intraday spend rows from the event table: one stream per event type."""
    return t.events.select(
        F.lit("org-events").alias("organization_id"),
        F.col("ts").alias("timestamp"),
        F.lit("Azure").alias("cloud_provider"),
        F.upper("event_type").alias("unified_category"),
        F.col("value").alias("cost"),
        F.lit(fixed.UNKNOWN).alias("normalized_env"),
        F.lit(fixed.UNKNOWN).alias("normalized_team"),
        F.lit(0).alias("is_anomaly"),
        F.lit("none").alias("anomaly_type"),
        F.col("event_id"),
    )


def organizations(t: Tables) -> DataFrame:
    """Tenant dimension from ``region``: created in key order."""
    return t.region.select(
        F.concat(F.lit("org-"), F.col("r_regionkey").cast("string")).alias("id"),
        F.col("r_name").alias("name"),
        F.lit("ENTERPRISE").alias("tier"),
        F.timestamp_add("DAY", F.col("r_regionkey"),
                        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
    )
