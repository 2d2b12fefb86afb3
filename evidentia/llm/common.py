"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a local temporary folder is taken.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        known = f"file://{tempfile.mkdtemp(prefix='evidentia-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table.

    This cuts lineage: a lost executor makes later stages reread files, not recompute
    what stands above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` dealt over ``n`` partitions by a hash of ``by``."""
    return df.repartition(n, F.xxhash64(*by))
