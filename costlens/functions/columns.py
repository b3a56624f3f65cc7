"""Scalar column functions (all JVM-side, all inside whole-stage codegen).

Money is summed as a decimal or as integer units of 1e-8, never coarser than
a billed rate, so that a sum does not depend on the order rows arrive in
(partitioning, retries); whole cents come after summing. Every derived double
comes from a single division or square root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens import fixed


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- B4 -----------------------------------------------------------------
def category_map(c: str | Column, mapping: dict[str, str]) -> Column:
    """Dictionary lookup with default ``OTHER`` (null input -> OTHER)."""
    c = col_(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(fixed.OTHER_CATEGORY)


# --- CSV null tokens ------------------------------------------------------
def na_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(c.isin(fixed.NA_TOKENS), F.lit(None)).otherwise(c)


# --- B6 -----------------------------------------------------------------
def lower_fill(c: str | Column, fill: str = fixed.UNKNOWN) -> Column:
    """lower-case, null (or a CSV null token) -> 'unknown'."""
    return F.coalesce(F.lower(na_to_null(c)), F.lit(fill))


# --- B5 -----------------------------------------------------------------
def json_tag(c: str | Column, key: str) -> Column:
    """Value of ``key`` in a JSON object string, lower-cased.

    missing key, invalid JSON, a non-object document or a null string give
    'unknown'; a key present with JSON null gives 'none'.
    """
    c = col_(c)
    keys = F.json_object_keys(c)
    val = F.get_json_object(c, f"$.{key}")
    return (F.when(keys.isNull() | ~F.array_contains(keys, key), F.lit(fixed.UNKNOWN))
            .when(val.isNull(), F.lit("none"))
            .otherwise(F.lower(val)))


# --- B7 -----------------------------------------------------------------
def parse_ts(c: str | Column) -> Column:
    """'YYYY-MM-DD[ HH:MM:SS[.ffffff]]' -> timestamp_ntz."""
    return na_to_null(c).cast("timestamp_ntz")


def to_day(c: str | Column) -> Column:
    return F.to_date(col_(c))


# --- B8 -----------------------------------------------------------------
def day_of_week(c: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(c))


def is_weekend(c: str | Column) -> Column:
    return day_of_week(c).isin(*fixed.WEEKEND_DAYS).cast("int")


# --- B9 -----------------------------------------------------------------
def cost_ratio(cost: str | Column, rolling_mean: str | Column) -> Column:
    return col_(cost) / (col_(rolling_mean) + F.lit(fixed.RATIO_EPS))


# --- B13 / B14 / B17 ------------------------------------------------------
def clamp_nonneg(c: str | Column) -> Column:
    return F.greatest(F.lit(0.0), col_(c))


def round_money(c: str | Column) -> Column:
    """Round to cents by the binary value (as a browser's toFixed(2) does)."""
    return F.round(col_(c) * 100) / 100


def cents(c: str | Column) -> Column:
    """Exact integer cents of a money value."""
    return F.round(col_(c) * 100).cast("long")


def exact(c: str | Column) -> Column:
    """Money as a decimal fine enough for any billed rate."""
    return col_(c).cast("decimal(28,10)")


def sum_cents(c: str | Column) -> Column:
    """Whole cents of an exact sum, rounded once, after summing."""
    return (F.round(F.sum(exact(c)), 2) * 100).cast("long")


#: Units of one dollar in integer moments.
UNITS = 100_000_000


def units(c: str | Column) -> Column:
    """Money in integer units of 1e-8, for exact moments."""
    return F.round(col_(c) * UNITS).cast("long")


def from_cents(c: str | Column) -> Column:
    return col_(c).cast("double") / 100


# --- B15 / B16 ------------------------------------------------------------
def ts_text(c: str | Column) -> Column:
    return col_(c).cast("string")


def date_of_text(c: str | Column) -> Column:
    """Text before the first blank, as a date."""
    return F.to_date(F.substring_index(col_(c), " ", 1))


def split_stream(c: str | Column) -> tuple[Column, Column]:
    s = F.split(F.coalesce(col_(c), F.lit(fixed.DEFAULT_STREAM)), "-")
    return F.element_at(s, 1), F.element_at(s, 2)


def stream_name(provider: str | Column = "cloud_provider",
                category: str | Column = "unified_category") -> Column:
    return F.concat_ws("-", col_(provider), col_(category))


# --- exact moments from integer sums ---------------------------------------
_TWO32 = 4294967296


def dec_to_double(x: Column) -> Column:
    """DECIMAL(38,0) -> DOUBLE, correctly rounded on every engine.

    Engines convert integers above 2**64 with different rounding, so the
    value is split into exact 32-bit halves, each converted exactly, and
    added once (a single IEEE rounding)."""
    x = x.cast("decimal(38,0)")
    lo = x % F.lit(_TWO32)
    hi = ((x - lo) / F.lit(_TWO32)).cast("long")
    return hi.cast("double") * F.lit(float(_TWO32)) + lo.cast("double")
