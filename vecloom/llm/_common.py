"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.scratch import delete as fs_delete
from vecloom.sources.scratch import settled as written
from vecloom.sources.scratch import shuffles_dropped
from vecloom.sources.ship import ship

__all__ = ["fs_delete", "partitions", "ship", "shuffles_dropped", "smallest", "table", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(df: DataFrame, n: int, count: int, *keys: str) -> DataFrame:
    """The n rows of df, which has `count`, with the smallest hashes of their keys.

    Rows are first filtered by hash to little more than n, so that a task sends its share of n and not n of its own.
    """
    share = (n + 8 * n**0.5 + 50) / max(1, count)
    h = F.xxhash64(*keys)
    kept = df if share >= 1 else df.where(h < F.lit(int(-(2**63) + share * 2**64)))
    return kept.orderBy(h, *keys).limit(n)
