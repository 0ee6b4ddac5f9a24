"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made since ``settled`` began, in its thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset, a local session (one process, as in tests) gets a folder
    of this machine; a cluster must name a shared one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local ")) and spark.conf.get("spark.master", "") != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", compression).parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` returns, written, and its folder; all that was written on the way is removed."""
    token = _made.set([])
    try:
        out = written(make())
        *passing, own = _made.get()
    finally:
        _made.reset(token)
    for path in passing:
        removed(spark, path)
    return out, own
