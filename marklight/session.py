"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "marklight", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARKLIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files) of an input directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str = "received_at") -> DataFrame:
    """One row per key: the delivery received last. Null keys are dropped.

    Re-deliveries repeat all values, so which one is kept only matters for ``order`` itself. ``max_by`` over
    a struct combines map-side, so a key that was delivered very often never gathers in one task. The struct holds every
    column given, which no later step prunes: select what is needed before.
    """
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in rest])
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(packed, F.coalesce(F.col(order).cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))).alias("_r"))
    return one.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir`` of the session.

    Only a local session may do without: it gets a temporary folder, which goes when the session ends. On a cluster an unset
    folder is an error, as each executor would write to a disk of its own.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("marklight.tmp.dir", None)
    if conf:
        return conf
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    at = tempfile.mkdtemp(prefix="marklight-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("marklight.tmp.dir", f"file://{at}")
    return f"file://{at}"


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there: a lost executor costs no recomputation, an iteration's plan doesn't grow and a
    Python stage used twice runs once. Columnar and compressed, unlike a checkpointed RDD. The table lives until ``free``
    or the end of the application, whichever comes first.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/marklight-{uuid.uuid4().hex}"
    fs, p = _hadoop_path(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._marklight_cut = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later result reads. Others, and tables freed before, are left alone."""
    for df in tables:
        path = getattr(df, "_marklight_cut", None)
        if path:
            fs, p = _hadoop_path(df.sparkSession, path)
            fs.delete(p, True)
            df._marklight_cut = None


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python stages find it wherever they run.

    Nothing is sent if the application was submitted with the package (``--py-files``) or runs off a wheel on every
    node: the copy sent is the same code. Queries call this; a program that only uses operators calls it once.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="marklight-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "marklight_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for base, folders, names in os.walk(root):
            folders[:] = sorted(x for x in folders if x != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("marklight", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)
