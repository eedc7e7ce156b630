"""The checks between sectors, entries and clusters as set operations on any table.

Each is one aggregate or one window over its keys, so one hash partitioning on a disk's key
serves all that are applied to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so map-side combined, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value varies, with the lowest and the highest one."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose range begins before the end of one that starts no later, in order of start and end."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reach", F.max(end).over(w)).where(F.col(start) < F.col("reach")).drop("reach")


def measured(df: DataFrame, keys: list[str], track: str, side: str, number: str, size: Column) -> DataFrame:
    """Tracks, sides, highest sector number, sectors, bytes and the largest sector of each key."""
    return df.groupBy(*keys).agg((F.max(track) + 1).alias("tracks"), F.greatest(F.lit(1), F.max(side) + 1).alias("sides"), F.max(number).alias("sectors"), F.count("*").alias("total_sectors"), F.sum(size).alias("disk_size"), F.max(size).alias("largest_sector"))


def duplicate_names(df: DataFrame, keys: list[str], name: str, order: str, raw: str) -> DataFrame:
    """Marks each later row of a name, and the first one where a later row differs from it."""
    w = Window.partitionBy(*keys, name).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(raw).over(w)
    rank = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return df.withColumns({"_first": first, "_rank": rank}).withColumn("_differs", F.max(F.when(F.col(raw) != F.col("_first"), 1).otherwise(0)).over(Window.partitionBy(*keys, name))).withColumn("duplicate", (F.col("_rank") > 1) | (F.col("_differs") == 1)).drop("_first", "_rank", "_differs")


def claims(df: DataFrame, keys: list[str], cluster: str, order: list[str], key: Column) -> DataFrame:
    """Rows that claim a cluster owned by an earlier row with another key."""
    w = Window.partitionBy(*keys, cluster).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_key", key).withColumn("_owner", F.first("_key").over(w)).where("_key <> _owner").drop("_key", "_owner")


def mismatches(df: DataFrame, keys: list[str], copy: str, cluster: str, link: str) -> DataFrame:
    """(keys, mismatched): clusters whose link isn't the same in all copies, cluster 0 aside."""
    cells = df.where(F.col(cluster) > 0).groupBy(*keys, cluster).agg((F.min(link) != F.max(link)).alias("bad"))
    return cells.groupBy(*keys).agg(F.sum(F.col("bad").cast("bigint")).alias("mismatched"))
