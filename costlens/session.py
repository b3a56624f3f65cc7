"""Spark session helpers shared by tests, bench and the driver entry.

Nothing here hides Spark: it builds a normal ``SparkSession`` with the
settings an operator of this library should use (UTC session zone, AQE
on, UI off) and offers small helpers used across the operators:

* ``checkpoint_dir`` - read ``spark.checkpoint.dir`` from the session and
  set a scratch one only when the session has none and runs in one process
  (tests, laptops); a cluster without the setting is an error.
* ``materialize`` - cut lineage by a written table in that folder.
* ``release`` - remove such tables once nothing reads them any more.
* ``shuffles_dropped`` - queries inside leave no shuffle files behind.
* ``share`` - ship a small, bounded model to the tasks.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "costlens") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("COSTLENS_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COSTLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's setting if present.

    A scratch folder of this machine is made only where the setting is absent
    and driver and executors are one process (a ``local`` master, as in tests);
    on a cluster without ``spark.checkpoint.dir`` this is an error, as tables
    in a local folder would be lost to the other machines.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="costlens-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", conf)
    if sc is None:
        return conf
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def share(spark: SparkSession, value):
    """Ship a small, bounded model to the tasks: a broadcast variable when
    the session has a SparkContext, the task closure otherwise. Returns a
    zero-argument getter usable inside the task."""
    try:
        bc = spark.sparkContext.broadcast(value)
        return lambda: bc.value
    except Exception:
        return lambda: value


def materialize(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Cut the lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder and reading it back. ``options`` go to the writer.

    Compared with an RDD checkpoint the table is columnar and compressed,
    and later reads prune columns. A lost executor re-reads the table
    instead of recomputing the plan. The shuffle files of the query go with its
    end: the table is read instead."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/costlens-materialized/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    _register_cleanup(spark, path)
    # the schema is known: skip footer inference on the read-back
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries that run inside are removed as each query ends,
    not when the driver's garbage collection finds them. For queries that end in a
    written table: nothing reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release(*frames: DataFrame) -> None:
    """Remove the tables of ``materialize`` that ``frames`` read: for those of which
    all that is still wanted has been written elsewhere. Other files stay."""
    for df in frames:
        read = {part for f in df.inputFiles() for part in f.split("/")}
        for path in [p for p in _CREATED if p.rsplit("/", 1)[1] in read]:
            _delete(df.sparkSession, path)
            _CREATED.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    jp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jp, True)


_CREATED: list[str] = []
_CLEANS = False


def _register_cleanup(spark: SparkSession, path: str) -> None:
    """Tables written by ``materialize`` are intermediate: remove the ones
    this process created when it exits (results returned earlier are lazy
    plans over them, so they must live as long as the process)."""
    global _CLEANS
    if not _CLEANS:
        import atexit
        _CLEANS = True

        def _drop() -> None:
            try:
                for p in _CREATED:
                    _delete(spark, p)
            except Exception:
                pass
        atexit.register(_drop)
    _CREATED.append(path)
