"""Session settings, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for own sessions (tests, bench); a cluster's session brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quernstone").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions or cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_quernstone_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quernstone-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/quernstone", "zip", os.path.dirname(here), os.path.basename(here)))
    sc._quernstone_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Only a local session without the setting gets a folder of its own, which goes at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster session must name its shared folder in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="quernstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def plain_path(uri: str) -> str | None:
    """The path of a file URI, None where the shared folder is no file system that can be mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def shared_file(spark: SparkSession, tag: str, *, released: bool = False) -> str | None:
    """A new folder for files that executors map into memory, None if the shared folder has no plain path; released: `release` deletes it."""
    base = plain_path(shared_dir(spark))
    if base is None:
        return None
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    os.makedirs(path)
    if released:
        _written.setdefault(spark.sparkContext.applicationId, []).append(f"file://{path}")
    return path


#: Tables written by `materialize`, by application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, tag: str, *, by: str | None = None) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it back: lineage ends there and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by `materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> int:
    """Delete every table that this application's queries wrote to the shared folder, once their results have been used; how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        discard(spark, path)
    return len(paths)
