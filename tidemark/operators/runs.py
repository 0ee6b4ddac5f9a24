"""Runs of several stages that go on where they were left."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Run:
    """A folder of tables, one for each stage, with a manifest of what each was made with.

    ``table`` makes a stage once: its rows are written, and then a line of the
    manifest.  What has its line, with equal settings, is read and not made again;
    a stage that was broken off has none, and is made anew in a folder of its
    own.  ``root`` must be reached by the driver and all executors.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def digest(settings: object) -> str:
        return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def made(self, stage: str, settings: object) -> bool:
        return self._exists(f"{self.root}/manifest/{stage}-{self.digest(settings)}/_SUCCESS")

    def table(self, stage: str, settings: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a stage: read if they are there, else made and kept."""
        name = f"{stage}-{self.digest(settings)}"
        path = f"{self.root}/{name}"
        if not self.made(stage, settings):
            make().write.mode("overwrite").parquet(path)
            line = [(stage, json.dumps(settings, sort_keys=True, default=str), path)]
            self.spark.createDataFrame(line, "stage string, settings string, path string").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{name}")
        return self.spark.read.parquet(path)

    def manifest(self) -> DataFrame:
        """stage, settings, path of all that is made."""
        schema = "stage string, settings string, path string"
        if not self._exists(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/manifest/*")
