"""Fixed-size count tables of hashed features, summed over all rows.

A task adds its rows into a dense table per key (a language, a label) and
hands out the table in blocks; blocks of the same key and number are added up
by Spark. What a key contributes does not depend on how many rows it has, so
a key with a third of all rows makes no hot task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
FIELDS = "key string, block int, table binary"


def emit(tables: dict[str, np.ndarray]):
    """Arrow batches of the blocks of each key's int64 table."""
    import pyarrow as pa
    for key, t in tables.items():
        parts = t.reshape(-1, min(BLOCK, t.size))
        used = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(used), pa.string()), pa.array(used, pa.int32()),
             pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["key", "block", "table"])


def add_up(blocks: DataFrame) -> DataFrame:
    def add(key, pdf):
        import pandas as pd
        total = np.zeros(len(pdf["table"].iloc[0]) // 8, np.int64)
        for t in pdf["table"]:
            total += np.frombuffer(t, np.int64)
        return pd.DataFrame({"key": [key[0]], "block": [key[1]], "table": [total.tobytes()]})

    # two levels, so that the number of tasks before does not matter
    salted = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    first = salted.groupBy("key", "block", "salt").applyInPandas(add, FIELDS)
    return first.groupBy("key", "block").applyInPandas(add, FIELDS)


def collect_tables(summed: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The tables themselves: keys x size numbers, whatever the row count."""
    out: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():
        t = out.setdefault(r["key"], np.zeros(size, np.int64))
        part = np.frombuffer(r["table"], np.int64)
        t[r["block"] * len(part):(r["block"] + 1) * len(part)] = part
    return out
