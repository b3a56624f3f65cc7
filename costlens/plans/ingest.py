"""The loader as a job: exports (and a forecast file) to the tenant tables.

Rules: without an export of any vendor, or without a registered tenant, the job
stops before it writes anything; a missing forecast is a warning and is skipped;
records that don't fit go to the quarantine, counted by vendor and reason. The job
has a load number: run again with it, it replaces what it wrote, and readers of
the tables take the newest load (``sources/versions.py``).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens import schema as SC
from costlens.operators import serve as SV
from costlens.sources import exports as EX
from costlens.sources import versions as V

log = logging.getLogger(__name__)


class IngestStopped(RuntimeError):
    """The job ended before it wrote anything."""


@dataclass
class Report:
    tenant: str
    spend_path: str
    quarantine_path: str
    forecast_path: str | None
    rejected: dict[tuple[str, str], int]
    warnings: list[str] = field(default_factory=list)


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def run_ingest(spark: SparkSession, exports: dict[str, str], organizations: DataFrame, out_dir: str,
               forecast: str | None = None, batch: str = "billing", number: int = 1) -> Report:
    """Load the exports ({vendor: path}) for the oldest tenant."""
    out_dir = out_dir.rstrip("/")
    tenant = SV.first_tenant(organizations).first()
    if tenant is None:
        raise IngestStopped("no registered organization: nothing was loaded")
    try:
        rows, rejected = EX.normalized_exports(spark, exports)
    except AnalysisException as e:
        if not _missing(e):
            raise
        raise IngestStopped(f"a billing export is missing: {e.getMessageParameters().get('path', '')}") from e
    report = Report(tenant["id"], f"{out_dir}/cloud_spend", f"{out_dir}/quarantine", None, {})
    spend = SV.stamp_tenant(rows, tenant["id"]).select(*[f.name for f in SC.CLOUD_SPEND.fields])
    V.write_load(spend, report.spend_path, batch, number)
    V.write_load(SV.stamp_tenant(rejected, tenant["id"]), report.quarantine_path, batch, number)
    report.rejected = {(r["vendor"], r[EX.REASON]): r["n"] for r in
                       rejected.groupBy("vendor", EX.REASON).agg(F.count(F.lit(1)).alias("n")).collect()}
    if forecast is not None:
        try:
            fc = spark.read.option("header", True).schema(_without_tenant()).csv(forecast)
        except AnalysisException as e:
            if not _missing(e):
                raise
            report.warnings.append(f"forecast file missing at {forecast}: skipped")
            log.warning(report.warnings[-1])
        else:
            report.forecast_path = f"{out_dir}/cloud_forecast"
            fc = SV.stamp_tenant(fc, tenant["id"]).select(*[f.name for f in SC.CLOUD_FORECAST.fields])
            V.write_load(fc, report.forecast_path, batch, number)
    return report


def _without_tenant():
    return type(SC.CLOUD_FORECAST)([f for f in SC.CLOUD_FORECAST.fields if f.name != V.TENANT])
