"""Session helpers."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "guestflow",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on.

    UTC session time zone (timestamps are compared as UTC wall clock), AQE with
    partition coalescing and skew-join splitting, UI off.
    """
    master = master or os.environ.get("GUESTFLOW_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("GUESTFLOW_DRIVER_MEMORY", "8g")))
    # Shuffle sizing: start from many partitions and let AQE coalesce them to
    # ~128 MB each, so a big shuffle never lands in a few oversized tasks and
    # a small one does not pay for thousands of empty ones.
    b = b.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        b = b.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                     os.environ.get("GUESTFLOW_SHUFFLE_PARTITIONS", "2000"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Where the session names none, a folder in its warehouse, which executors
    share as well. A cluster must name one or the other: the default warehouse is a
    folder of the driver's machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and "spark.sql.warehouse.dir" not in dict(spark.sparkContext.getConf().getAll()):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


_SCRATCH: dict = {}  # application id -> folder


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared checkpoint folder. It is made on
    first use and goes, with all that is in it, when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/guestflow-{app}"
        fs, path = _file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SCRATCH[app] = folder
    return _SCRATCH[app]


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def folder_has(spark: SparkSession, folder: str, name: str) -> bool:
    fs, path = _file_system(spark, f"{folder}/{name}")
    return fs.exists(path)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


_SHIPPED: set = set()  # application ids


def ship_package(spark: SparkSession) -> None:
    """Make ``guestflow`` importable in the Python workers (the
    stateful alerts and custom drafters run there): zip the package once and add it
    with ``addPyFile``, which serves it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="guestflow-pkg-"), "guestflow.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
