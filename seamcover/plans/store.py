"""Stage results on disk, found again by a hash of what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Goes into every signature; raised when results change.
VERSION = 1


def signature(**parts: object) -> str:
    return hashlib.sha256(json.dumps(parts | {"version": VERSION}, sort_keys=True, default=str).encode()).hexdigest()[:16]


class StageStore:
    """Parquet folders ``root/stage-signature``; a folder counts once Spark's writer has committed it.

    A changed parameter changes the signatures from its stage on, so earlier stages are found and reused, and an
    interrupted run goes on behind its last whole stage. ``root`` must be shared by all executors.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stage(self, name: str, sign: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}-{sign}"
        if not self._committed(path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _committed(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)
