"""Spark session defaults and lineage helpers.

Everything here is plain session configuration: AQE on (runtime coalescing,
skew-join splitting), UTC session time zone, Arrow for pandas UDFs, UI off.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows above which a derived "small" side (request batches, clause tables) is
# no longer broadcast explicitly and is left to a shuffle join instead.
BROADCAST_ROW_LIMIT = 200_000


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "folio") -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    Only a local session (tests, the bench) gets a size: shuffle partitions, driver
    memory and a private checkpoint folder. On a cluster these are the cluster's.
    """
    master = master or os.environ.get("FOLIO_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is None and "FOLIO_SHUFFLE_PARTITIONS" in os.environ:
        shuffle_partitions = int(os.environ["FOLIO_SHUFFLE_PARTITIONS"])
    if master.startswith("local"):
        shuffle_partitions = shuffle_partitions or 8
        builder = (builder.config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "16g"))
                   .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="folio-ckpt-")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read; a cluster
    session without it is an error, as executors would not see each other's
    files. A local session without it gets a private scratch folder.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="folio-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf)
    return conf.removeprefix("file:")


def mounted_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder name below the shared checkpoint folder as a path that every worker has mounted; none where that folder is a store."""
    import uuid

    base = checkpoint_dir(spark)
    return None if "://" in base else f"/{base.strip('/')}/folio-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as parquet in the shared checkpoint folder, read back: for loops that join what they carry with itself. A checkpoint keeps
    the estimated size, which such a loop multiplies each round, until planning takes longer than the work; files have their true size."""
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/folio-written-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is no longer referred to: Spark removes them when the driver's garbage is collected, which a
    driver with room to spare leaves until long after the disk is full."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes in fewer partitions (a small table in one file), else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_side(df: DataFrame, small: bool | None, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` when the caller has proven it small (``small=True``),
    leave it to the planner when proven large (``False``), or count it (``None``)."""
    from pyspark.sql import functions as F

    if small is None:
        return bounded_broadcast(df, max_rows)
    return F.broadcast(df) if small else df


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be under ``max_rows``.

    Used for request-derived tables (clauses, request packages) whose size is
    set by the caller's batch, never by the corpus. Beyond the bound the
    DataFrame is returned as is and the planner shuffles (AQE may still pick a
    broadcast from runtime statistics).
    """
    from pyspark.sql import functions as F

    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``folio`` importable in Python workers (Arrow UDFs import it).

    The package is zipped once per application into the checkpoint folder and
    added with ``addPyFile``, Spark's own mechanism for distributing Python
    code to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    base = checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        staging = tempfile.mkdtemp(prefix="folio-pkg-")  # zip is built locally, then shipped by Spark
    else:
        staging = os.path.join(base, "folio-pkg")
        os.makedirs(staging, exist_ok=True)
    zpath = os.path.join(staging, f"folio-{sc.applicationId}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
