"""Scratch tables: lineage is cut by written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, Scratch] = {}


@atexit.register
def release_all() -> None:
    """Delete what is still there of all scratch tables of this process; also done when it ends."""
    for scratch in list(_OPEN.values()):
        with suppress(Exception):
            scratch.release()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """The folder of local sessions that name none: one for the process, gone with it."""
    base = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


class Scratch:
    """Tables written once and read back, in the shared folder of ``spark.checkpoint.dir``.

    They cut lineage: what a later stage re-reads after an executor is lost is this table, not a
    re-evaluated plan. Only where the session names no folder and is local is a temporary one made.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            base = _own_folder()
        self.root = f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
        _OPEN[self.root] = self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete what was written, once nothing reads it any more; what is never released goes with the process."""
        _OPEN.pop(self.root, None)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
