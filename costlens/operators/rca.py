"""Root-cause context and owner attribution for every incident at once
(C3/J1, J2, J3, J4, B18).

The context window of an incident on day d is d-2 00:00 .. d+1 00:00
(inclusive, both bounds at midnight, D12): three whole days, and of the fourth
only what is stamped midnight. So everything asked about an incident follows
from a day cube, built in one pass over the spend rows with partial sums: per
(tenant, stream, day, team, env) the amount and count, the same of the rows at
midnight, and the row that sorts last (which decides whether the day is an
incident). An incident then meets its four days of the cube by an equi join:
each is asked for by its distance from the incident, and the last one gives its
midnight part only. No spend row is joined, and the cube has at most one row for
a day and owner, however many rows a stream has.

``rca_context`` (C3) returns the rows themselves and is the only operator here
that joins them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators import serve as SV
from costlens.operators.keyed import join_groups
from costlens.schema import S
from costlens.session import materialize

TENANT_STREAM = ["organization_id", *S]
OWNER = ["normalized_team", "normalized_env"]


def incidents(cloud_spend: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """The incident queue of every tenant and stream: days whose last row is
    flagged (the dashboard rule, C7 over E11)."""
    lp = SV.last_per_day(cloud_spend, keys)
    return lp.where(F.col("is_anomaly") == 1).select(*keys, "date", F.col("anomaly_type").alias("type"))


def _bounds(date: Column) -> tuple[Column, Column]:
    lo = F.date_sub(date, fixed.RCA_DAYS_BEFORE).cast("timestamp_ntz")
    hi = F.date_add(date, fixed.RCA_DAYS_AFTER).cast("timestamp_ntz")
    return lo, hi


def rca_context(cloud_spend: DataFrame, inc: DataFrame, keys: Sequence[str] = TENANT_STREAM,
                how: str = "inner") -> DataFrame:
    """The spend rows in each incident's window (``how='left'`` keeps
    incidents without rows)."""
    days = _days(inc, keys)
    rows = cloud_spend.select(*keys, "timestamp", "cost", *OWNER).withColumn("_day", C.to_day("timestamp"))
    j = join_groups(days, rows, [*keys, "_day"])
    lo, hi = _bounds(F.col("date"))
    j = j.where((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi))
    j = j.select(*keys, "date", "type", "timestamp", C.ts_text("timestamp").alias("ts_text"), "cost", *OWNER)
    if how == "left":
        j = join_groups(inc, j.drop("type"), [*keys, "date"], "left")
    return j


def _days(inc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each incident once for each day that its window touches."""
    return inc.select(*keys, "date", "type", F.explode(F.sequence(
        F.lit(-fixed.RCA_DAYS_BEFORE), F.lit(fixed.RCA_DAYS_AFTER))).alias("_off")) \
        .withColumn("_day", F.date_add("date", F.col("_off")))


def day_cube(cloud_spend: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """Per (keys, day, team, env): amount and count of all rows and of those at
    midnight, and the last row of the day. One pass; amounts are exact."""
    ts = F.col("timestamp")
    midnight = ts == F.date_trunc("day", ts).cast("timestamp_ntz")
    return cloud_spend.groupBy(*keys, C.to_day("timestamp").alias("_day"), *OWNER).agg(
        F.sum(C.exact("cost")).alias("amount"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(midnight, C.exact("cost"))).alias("midnight_amount"), F.count_if(midnight).alias("midnight_n"),
        F.max(F.struct("timestamp", "cost", "is_anomaly", "anomaly_type")).alias("last"))


def cube_incidents(cube: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """``incidents`` from the cube."""
    last = cube.groupBy(*keys, F.col("_day").alias("date")).agg(F.max("last").alias("last"))
    return last.where("last.is_anomaly = 1").select(*keys, "date", F.col("last.anomaly_type").alias("type"))


def incident_windows(cube: DataFrame, inc: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """Per incident and (team, env) in its window: the amount on the event day,
    that of the days before it, and the number of rows in the window."""
    cells = cube.select(*keys, "_day", *OWNER, "amount", "n", "midnight_amount", "midnight_n")
    j = join_groups(_days(inc, keys), cells, [*keys, "_day"])
    whole = F.col("_off") < fixed.RCA_DAYS_AFTER
    rows = F.when(whole, F.col("n")).otherwise(F.col("midnight_n"))
    amount = F.when(whole, F.col("amount")).otherwise(F.col("midnight_amount"))
    j = j.select(*keys, "date", "type", "_off", *OWNER, rows.alias("n"), amount.alias("amount")).where("n > 0")
    return j.groupBy(*keys, "date", "type", *OWNER).agg(
        F.coalesce(F.sum(F.when(F.col("_off") == 0, F.col("amount"))), F.lit(0)).alias("event"),
        F.coalesce(F.sum(F.when(F.col("_off") < 0, F.col("amount"))), F.lit(0)).alias("before"),
        F.sum("n").alias("n_records"))


def owner_jump(windows: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """Per incident and (team, env): cost on the event day against the
    mean of the two days before it; the jump is kept in half-cents so it is
    exact (jump = event - before / 2)."""
    g = windows.select(*keys, "date", "type", *OWNER, *[
        (F.round(c, 2) * 100).cast("long").alias(f"{c}_cents") for c in ("event", "before")])
    j2 = 2 * F.col("event_cents") - F.col("before_cents")
    return g.select("*", j2.alias("jump_half_cents"), (j2.cast("double") / 200).alias("jump"),
                    (F.abs(j2).cast("double") / 200).alias("abs_jump"))


def owner_attribution(jumps: DataFrame, keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """The (team, env) with the largest jump per incident (ties: team,
    env ascending), a partial aggregate of an ordered struct."""
    rest = [c for c in jumps.columns if c not in (*keys, "date", *OWNER)]
    first = F.min(F.struct((-F.col("jump_half_cents")).alias("_least"), *OWNER, *rest)).alias("_first")
    return jumps.groupBy(*keys, "date").agg(first).select(
        *keys, "date", *[F.col(f"_first.{c}").alias(c) for c in jumps.columns if c not in (*keys, "date")])


def _money_text(half_cents: Column) -> Column:
    """Exact text of half-cents as dollars with three decimals."""
    mills = F.abs(half_cents) * 5
    sign = F.when(half_cents < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, (mills / 1000).cast("long").cast("string"), F.lit("."),
                    F.lpad((mills % 1000).cast("string"), 3, "0"))


def report_text(date: Column, kind: Column, stream: Column, note: Column) -> Column:
    """The incident report, one fixed template."""
    lines = [F.lit(fixed.REPORT_HEADER),
             F.concat(F.lit("Target Event Date: "), date.cast("string")),
             F.concat(F.lit("Identified Topology: "), F.coalesce(kind, F.lit(fixed.REPORT_DEFAULT_TYPE))),
             F.concat(F.lit("Platform Stream: "), F.coalesce(stream, F.lit(fixed.REPORT_DEFAULT_STREAM))),
             F.lit(""), F.lit("Executive Summary of Investigation:"),
             F.coalesce(note, F.lit(fixed.REPORT_NO_NOTES)), F.lit(""), F.lit("Action Item Matrix:"),
             *[F.lit(a) for a in fixed.REPORT_ACTIONS], F.lit(fixed.REPORT_FOOTER)]
    return F.concat_ws("\n", *lines)


def rca_report(cloud_spend: DataFrame, inc: DataFrame | None = None,
               keys: Sequence[str] = TENANT_STREAM) -> DataFrame:
    """One report per incident: fetch the window, attribute the jump,
    write the report; an incident with no rows gets the skip note. Without
    ``inc`` every incident of the rows is reported, from the same one pass."""
    cube = materialize(day_cube(cloud_spend, keys), "incident-cube")
    # incidents and their windows are bounded by incident days and owners, and
    # feed three branches
    inc = materialize(cube_incidents(cube, keys) if inc is None else inc, "incidents")
    windows = materialize(incident_windows(cube, inc, keys), "incident-windows")
    return _reports(inc, windows, keys)


def _reports(inc: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = windows.groupBy(*keys, "date").agg(F.sum("n_records").alias("n_records"))
    top = owner_attribution(owner_jump(windows, keys), keys).select(
        *keys, "date", *OWNER, "jump_half_cents")
    j = join_groups(join_groups(inc, counts, [*keys, "date"], "left"), top, [*keys, "date"], "left")
    n = F.coalesce(F.col("n_records"), F.lit(0))
    summary = F.concat(
        F.lit("Triage Analysis Complete:\nLargest jump: team "), F.col("normalized_team"),
        F.lit(", env "), F.col("normalized_env"), F.lit(", "), _money_text(F.col("jump_half_cents")),
        F.lit(" USD on the event day against the mean of the two prior days ("),
        n.cast("string"), F.lit(" records)."))
    note = F.when(n == 0, F.lit(fixed.REPORT_SKIP_NOTE)).otherwise(summary)
    stream = C.stream_name()
    return j.select(*keys, "date", "type", n.alias("n_records"),
                    F.col("normalized_team").alias("owner_team"), F.col("normalized_env").alias("owner_env"),
                    report_text(F.col("date"), F.col("type"), stream, note).alias("report"))


def rca_single(cloud_spend: DataFrame, tenant: str, date: str | dt.date, kind: str | None = None,
               stream: str | None = None) -> DataFrame:
    """J4 for one incident as a caller names it: tenant, day, anomaly type and
    stream text ('AWS-COMPUTE', also the default). Tenant, stream and the
    window's bounds are literals, so they reach the scan and prune it; the rest
    is the batch path over what is left."""
    provider, category = (stream or fixed.DEFAULT_STREAM).split("-", 1)
    day = dt.date.fromisoformat(str(date))
    lo, hi = (F.lit(str(day + dt.timedelta(days=k))).cast("date").cast("timestamp_ntz")
              for k in (-fixed.RCA_DAYS_BEFORE, fixed.RCA_DAYS_AFTER))
    ts = F.col("timestamp")
    rows = SV.stream_filter(cloud_spend.where(F.col("organization_id") == tenant), provider, category)
    inc = cloud_spend.sparkSession.range(1).select(
        F.lit(tenant).alias("organization_id"), F.lit(provider).alias("cloud_provider"),
        F.lit(category).alias("unified_category"), F.lit(str(day)).cast("date").alias("date"),
        F.lit(kind).cast("string").alias("type"))
    return rca_report(rows.where((ts >= lo) & (ts <= hi)), inc)


def fetch_note(n: Column, provider: Column, category: Column) -> Column:
    return F.concat(F.lit("Successfully fetched "), n.cast("string"), F.lit(" scoped records for "),
                    provider, F.lit(" "), category, F.lit("."))
