"""Session helpers: a tuned local session, and the shared folder jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "gridweave", memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only when that setting is absent (tests, single machine) is a temporary folder chosen, and then it
    is registered as the checkpoint folder so every later call in the session agrees on it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="gridweave-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder once and go on from there.

    For results that several passes read: they are not computed again, and every pass sees the same
    rows even when executors are lost in between.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any storage that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="gridweave-"), "gridweave_code.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for folder, _, names in os.walk(os.path.join(root, "gridweave")):
            for name in names:
                if name.endswith(".py"):
                    packed.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()


def shuffle_width(spark: SparkSession, most: int = 8192) -> int:
    """How many order blocks to cut data into: one per shuffle partition, with a fixed upper bound."""
    return max(2, min(most, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
