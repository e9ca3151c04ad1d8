"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Paths that this process has given out.
_MADE: list[str] = []


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewright-core-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_intermediate(spark: SparkSession) -> int:
    """Delete what this process has written to shared paths and say how many there were; to be called once no result that reads them is needed any more."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into a fresh shared path and read back, which cuts its lineage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_page(df: DataFrame, key: Sequence[str] = ("doc", "page")) -> DataFrame:
    """``df`` dealt by its page (or another key) into as many partitions as the session shuffles into. The number is stated, so that tables dealt alike meet in place, and Spark leaves out a deal that is
    there already. The session is told that joins on the page and more (cells, segments) need no further shuffle of tables that lie by page on both sides."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *key)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and read back dealt by page once for all readers, which the session keeps."""
    return by_page(written(df, name)).persist()
