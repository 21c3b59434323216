"""Session helpers: a configured local session for tests and scripts, and the
shared folder used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "scrutin") -> SparkSession:
    """Return the active session or build a local one.

    On a cluster the session already exists (spark-submit) and is returned
    unchanged except for a checkpoint folder when none is configured.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCRUTIN_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_CHECKPOINT_DIRS: dict = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir`` (or a directory already given to
    ``setCheckpointDir``). When neither exists, a local run (tests) gets a
    scratch folder; a cluster is refused, as its machines share no such folder.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    key = id(sc)
    if key not in _LOCAL_CHECKPOINT_DIRS:
        existing = sc.getCheckpointDir()
        if existing:
            # setCheckpointDir adds a random sub-folder; use its parent
            _LOCAL_CHECKPOINT_DIRS[key] = existing.rsplit("/", 1)[0]
        else:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            d = tempfile.mkdtemp(prefix="scrutin-ckpt-")
            sc.setCheckpointDir(d)
            _LOCAL_CHECKPOINT_DIRS[key] = d
    return _LOCAL_CHECKPOINT_DIRS[key]


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


def materialize(df: DataFrame, name: str | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder (``options`` are the writer's) and read it back.

    This cuts lineage (a lost executor re-reads the files instead of
    recomputing the whole plan) and is used between SOM epochs and for index
    tables. Never a machine-local folder: the path comes from
    ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    # per application, so one call can drop an application's intermediates
    path = scratch_path(spark, "tables", spark.sparkContext.applicationId, name or uuid.uuid4().hex)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a statement go as soon as it has run.
    Otherwise they stay on the executors' disks until the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's materialised intermediates (index and map
    tables, which are keyed for reuse, are kept)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "tables", spark.sparkContext.applicationId))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 1)


#: Estimated bytes up to which a table is spread by a shuffle; bytes of a task
#: that texts are dealt to.
SPREAD_BYTES, TASK_BYTES = 256 << 20, 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, task_bytes: int | None = None) -> int:
    """Tasks to deal a table to: ``spark.sql.shuffle.partitions``, and more
    where one would get over ``task_bytes`` (``TASK_BYTES``) of it. An estimate of petabytes is
    none: rows that are not read from files have no size the planner knows."""
    size = estimated_bytes(df)
    least = default_parallelism(df.sparkSession)
    return max(least, -(-size // (task_bytes or TASK_BYTES))) if size < 1 << 53 else least


def spread(df: DataFrame) -> DataFrame:
    """A small table over ``spark.sql.shuffle.partitions`` tasks, where it may
    be packed into one file and so into one task; tables estimated above
    ``SPREAD_BYTES`` have splits of their own and are not shuffled."""
    return df.repartition(default_parallelism(df.sparkSession)) if estimated_bytes(df) <= SPREAD_BYTES else df


# Rows below which a side may be broadcast; sides are counted before they are
# hinted, so nothing whose size grows with the data is broadcast unchecked.
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count proves it small; otherwise return it
    unhinted so the planner (and AQE at runtime) shuffles both sides."""
    from pyspark.sql import functions as F
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def literal_frame(spark: SparkSession, values, name: str = "value", dtype: str = "string") -> DataFrame:
    """A small one-column DataFrame built from literals inside the JVM (no
    Python round trip); for query-sized or configuration-sized lists."""
    from pyspark.sql import functions as F
    vals = list(values)
    if not vals:
        return spark.range(0).select(F.lit(None).cast(dtype).alias(name))
    arr = F.array(*[F.lit(v).cast(dtype) for v in vals])
    return spark.range(1).select(F.explode(arr).alias(name))
