"""The folder that driver and executors share, staged tables and reliable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary one of this machine
    will do in local mode; on a cluster it is an error, as executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = folder or tempfile.mkdtemp(prefix="tidemark-")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, with the writer's ``options``, and reads it back: later passes reread files, and a lost executor
    costs no more than a task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, on whatever file system holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that the library has written, with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shipped(spark: SparkSession) -> None:
    """Sends the library to Python workers, once a session: functions that run there name its modules, and executors need not
    have it installed."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if getattr(context, "_tidemark_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark-library.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True
