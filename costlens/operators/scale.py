"""Per-stream min-max scaling (B11) without a whole-stream window: the
min/max table (one row per stream) is aggregated with a partial aggregate,
written and joined back, so that it is broadcast while it is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.operators import aggregates as A
from costlens.operators.keyed import join_stats
from costlens.schema import S


def minmax_scale(df: DataFrame, features: Sequence[str], keys: Sequence[str] = S,
                 suffix: str = "_scaled", stats: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) per stream; a constant feature scales to 0. ``stats``
    is ``minmax_stats``, if the caller has it."""
    # a null key is a stream of its own
    j = join_stats(df, A.minmax_stats(df, features, keys) if stats is None else stats, keys)
    cols = []
    for f in features:
        lo, hi = F.col(f"{f}_min"), F.col(f"{f}_max")
        cols.append(F.when(hi == lo, F.lit(0.0)).otherwise((F.col(f) - lo) / (hi - lo))
                    .alias(f"{f}{suffix}"))
    return j.select(*df.columns, *cols)
