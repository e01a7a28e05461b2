"""Session settings that results depend on, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Datasets up to this many rows may be broadcast or ranked inside one task; everything
# larger goes through a shuffle or a split.  Always compared with a measured count.
SMALL_ROWS = 1_000_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can
    import it wherever the driver was started and however it was installed there."""
    context = spark.sparkContext
    if getattr(context, "_ripen_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ripen-package-"), "ripen_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._ripen_shipped = True


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that day floors, epoch seconds and re-planning rely on, and make
    the package known to the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def build_session(app: str = "ripen", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare_session(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names; make one up only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ripen-checkpoint-"))
    else:
        raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")


def small_side(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows; otherwise left to a shuffle."""
    return F.broadcast(df) if n_rows <= SMALL_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder.

    Used where a result is read many times (training rows per epoch, predictions per
    calibration step): later jobs restart from files, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []
_BUCKETED: dict[str, str] = {}


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For wide rows that several jobs read in part: unlike a checkpoint, the table is columnar,
    so each job reads its columns and row groups only.  Row order is not kept.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    _STORED.append(folder)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    stored._ripen_folder = folder
    return stored


def store_in_buckets(df: DataFrame, n: int, column: str) -> DataFrame:
    """As ``store``, one file per bucket of ``column``: grouping or joining by it later moves no row."""
    spark = df.sparkSession
    folder, name = shared_folder(spark, "buckets"), f"ripen_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").bucketBy(n, column).option("path", folder).saveAsTable(name)
    _STORED.append(folder)
    _BUCKETED[folder] = name
    return spark.table(name)


def stored_mark() -> int:
    return len(_STORED)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if folder in _BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {_BUCKETED.pop(folder)}")
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession, mark: int) -> None:
    """Delete the tables stored since ``mark``."""
    while len(_STORED) > mark:
        _delete(spark, _STORED.pop())


def discard(stored: DataFrame) -> None:
    """Delete one stored table, whose readers are done."""
    _STORED.remove(stored._ripen_folder)
    _delete(stored.sparkSession, stored._ripen_folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, reachable by all executors."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"
