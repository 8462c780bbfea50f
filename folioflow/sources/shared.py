"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where that is unset and the session is on one machine; elsewhere an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-folioflow-", dir="/tmp"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that later jobs read rows that are fixed and survive lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables written here, once no later job reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            own = [x for x in _made if folder.removeprefix("file:").lstrip("/") == x.removeprefix("file:").lstrip("/")]
            for x in own:
                _delete(spark, x)
                _made.remove(x)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Deletes all folders made here so far and returns their number; for when no DataFrame over them is needed any more."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n
