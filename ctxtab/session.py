"""Session helpers: a tuned local session for tests/bench and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "ctxtab") -> SparkSession:
    """Session for tests and benchmarks (a cluster job brings its own)."""
    master = master or os.environ.get("CTXTAB_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.driver.memory", os.environ.get("CTXTAB_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    untouched; without it a cluster job fails here, as executors could not read
    each other's files.  Local runs (tests, bench) get a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="ctxtab-ckpt-")
    sc.setCheckpointDir(path)
    return path


def reuse(df: DataFrame) -> DataFrame:
    """Keep a derived input that several fit passes scan (memory, spilling to disk).

    A lost block is recomputed from lineage, so executor loss is survived;
    Spark evicts it under memory pressure.  Used where one operator runs
    several aggregations plus the transform over the same derived table.
    """
    from pyspark import StorageLevel
    return df if df.storageLevel.useMemory or df.storageLevel.useDisk else df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ctxtab`` importable in Python workers (Arrow kernels, grouped UDFs).

    A cluster job normally passes the package with ``--py-files``; when it is
    not importable there, the driver zips its copy once per context and adds
    it with ``addPyFile`` (Spark distributes it to every executor).
    """
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="ctxtab-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
