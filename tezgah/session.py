"""Session set-up and the one place that decides where intermediate tables are written."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def session(app: str = "tezgah", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the caller's own session is used."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python: sends it along, once per application, unless they find it anyway
    (by PYTHONPATH, or in local mode by the working directory)."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_tezgah_shipped", False):
        return
    sc._tezgah_shipped = True
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (sc.master.startswith("local[") and os.getcwd() == root) or not os.path.isdir(root):
        return
    where = tempfile.mkdtemp(prefix="tezgah-code-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    with zipfile.ZipFile(f"{where}/tezgah.zip", "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tezgah")):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(f"{where}/tezgah.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. A temporary one is used where that is unset and the master
    is local; on a cluster it would be lost with its machine, so there the setting is required."""
    global _own_dir
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tezgah-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


#: Lets Spark remove the shuffle files of a write when it is done; otherwise they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives the loss of any executor."""
    return written_parts([df], name)


def written_parts(parts: Iterable[DataFrame], name: str = "t") -> DataFrame:
    """Writes tables of the same columns, one after the other, as one: the shuffle files of one are gone before the next begins."""
    path = schema = None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            ship(spark)
            path, schema = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}", df.schema
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)
