"""Tables that iterative plans write between rounds, so that a round starts from files and not from all earlier rounds."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='docquarry-')}"


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; an own folder only where all run in one process and it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a table is dealt out by its size.
ROWS = 500_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` of about ``n`` rows dealt by ``keys`` to tasks of about ``ROWS``, whose number adaptive plans leave as it is; small tables stay.

    Adaptive plans merge tasks by bytes after compression, and ids compress so well that one would sort many millions.
    """
    parts = -(-n // ROWS)
    return df if parts <= 4 else df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the shared scratch space."""
    return f"{base(spark)}/docquarry/{tag}-{uuid.uuid4().hex}"
