"""The nightly batch as one Spark job.

normalise the three exports -> score (statistical, forest, reconstruction)
-> vote -> clean the daily series -> route and forecast 90 days -> write
the tenant tables. The chain is one lazy plan cut at the points where a
stage is read more than once (the operators materialise those in the
checkpoint folder); the two outputs are Parquet tables partitioned by
tenant, written with dynamic partition overwrite so a rerun replaces the
batch instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens import schema as SC
from costlens.operators import detect as D
from costlens.operators import forecast_models as M
from costlens.operators import forecast_window as FW
from costlens.operators import iforest as IF
from costlens.operators import normalize as N
from costlens.operators import reconstruct as RC
from costlens.operators import serve as SV
from costlens.operators import windows as W
from costlens.plans.ingest import IngestStopped
from costlens.session import materialize
from costlens.sources import exports as EX
from costlens.sources import files as IO
from costlens.sources import tables as T


def scored_spend(spend: DataFrame) -> DataFrame:
    """Every spend row with the three tier flags and the vote."""
    spend = materialize(spend, "spend-rows")
    feat = W.rolling_features(spend, keep_index=True, written=True)
    ml = IF.isolation_forest(feat, written=True)
    dl = RC.sequence_reconstruction(ml)
    return D.ensemble_vote(D.broadcast_day_score(dl, D.day_scores(spend)))


def run_batch(spark: SparkSession, spend: DataFrame, organizations: DataFrame, out_dir: str,
              flag: str = "ensemble_is_anomaly", mode: str = "replace_partition") -> dict[str, str]:
    """Score canonical spend rows for the oldest tenant, forecast its streams and
    write ``cloud_spend`` and ``cloud_forecast`` under ``out_dir``. Without a
    registered tenant the batch stops before it scores anything. ``flag``
    chooses which column becomes ``is_anomaly`` in the served table (the
    vote by default; ``'label'`` keeps the input label)."""
    first = SV.first_tenant(organizations).first()
    if first is None:
        raise IngestStopped("no registered organization: nothing was written")
    tenant = first["id"]
    scored = scored_spend(spend)
    served = scored if flag == "label" else scored.withColumn("is_anomaly", F.col(flag).cast("int"))
    cloud_spend = SV.stamp_tenant(served, tenant).select(*[f.name for f in SC.CLOUD_SPEND.fields])
    spend_path, fc_path = f"{out_dir.rstrip('/')}/cloud_spend", f"{out_dir.rstrip('/')}/cloud_forecast"
    IO.write_tenant_table(cloud_spend, spend_path, mode=mode)
    # forecasts use the label-cleaned daily series of the served table
    series = FW.cleaned_series(IO.read_tenant_table(spark, spend_path).where(
        F.col("organization_id") == tenant).drop("organization_id"))
    fc = SV.stamp_tenant(M.production_forecast(series), tenant)
    IO.write_tenant_table(fc.select(*[f.name for f in SC.CLOUD_FORECAST.fields]), fc_path, mode=mode)
    return {"cloud_spend": spend_path, "cloud_forecast": fc_path}


def run_nightly(spark: SparkSession, sf_dir: str, out_dir: str, flag: str = "ensemble_is_anomaly",
                mode: str = "replace_partition") -> dict[str, str]:
    """The batch on the driver tables under ``sf_dir``."""
    t = T.Tables(spark, sf_dir)
    spend = N.union_clouds(N.normalize_aws(T.raw_aws(t)), N.normalize_gcp(T.raw_gcp(t)),
                           N.normalize_azure(T.raw_azure(t)))
    return run_batch(spark, spend, T.organizations(t), out_dir, flag, mode)


def run_nightly_exports(spark: SparkSession, exports: dict[str, str], organizations: DataFrame, out_dir: str,
                        flag: str = "ensemble_is_anomaly", mode: str = "replace_partition") -> dict[str, str]:
    """The batch on the vendors' CSV exports ({vendor: path}); records that don't
    fit are written to ``quarantine`` beside the tables."""
    spend, rejected = EX.normalized_exports(spark, exports)
    paths = run_batch(spark, spend, organizations, out_dir, flag, mode)
    quarantine = f"{out_dir.rstrip('/')}/quarantine"
    rejected.write.mode("overwrite").parquet(quarantine)
    return {**paths, "quarantine": quarantine}
