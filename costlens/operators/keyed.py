"""Joins on group keys in which a null key is a group of its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.session import materialize


def stream_id(keys: Sequence[str]) -> Column:
    """One number for a stream, null keys apart from each other."""
    return F.xxhash64(*[c for k in keys for c in (F.col(k).isNull(), F.col(k))])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` for the same keys, null
    equal to null."""
    if not keys:
        raise ValueError("groups need a key")
    named = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_of_{k}" for k in keys])


def join_stats(left: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_groups`` with a table of one row a group that is derived from rows.

    It is written first, so the planner sees its real size and not one guessed
    from the rows: a small one is broadcast and the rows stay where they are.
    Dealt by the keys, a few groups would put all rows into as many tasks, and
    adaptive execution doesn't mend that: a table of a few keys leaves most
    partitions empty, for which it refuses to turn to a broadcast."""
    return join_groups(left, materialize(stats, "group-stats"), keys, how)
