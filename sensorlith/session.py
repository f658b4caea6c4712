"""Session set-up: UTC, adaptive execution, the package on the workers, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "sensorlith") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master.startswith("local[") or master == "local":  # a cluster names a folder that its executors share
        spark = spark.config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="sensorlith-"))
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """All times in the data are naive UTC, so every query runs with a UTC session; workers get the package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application: its functions run there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sensorlith-ship-")) / "sensorlith.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one machine may
    go without: there a temporary folder takes its place.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named and current.isDefined():
        return current.get()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sensorlith-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, never used twice. Who writes there may run Python on the workers, so they get the package."""
    ship(spark)
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for those who read some of its columns several times."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
