"""Rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the highest score -weight / ln(u), u being a uniform number
in (0, 1) from md5(key, shard). A score depends on one key and one shard only, so adding a
shard moves records to it alone, dropping one moves only its own, and a change of weight moves
records only to or from that shard. The expected share is weight / sum of weights.

Defined results: a null key hashes as the text ``null`` of its own kind; empty and very long keys are
keys like any other; repeated keys go to the same shard; equal scores go to the lowest shard number;
weights must be positive; other columns, whatever their names, are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards by number and weight in the registered query, before and after a shard is added.
WEIGHTS = {k: 1.0 + k % 3 for k in range(16)}
GROWN = WEIGHTS | {16: 2.0}


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard number of a key; JVM expressions only, no shuffle."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive, for one shard at least")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))

    def score(shard: int, weight: float) -> Column:
        # 52 bits of the digest, moved off 0 and 1
        u = (F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{shard}"))), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(2.0**52)
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("s"), F.lit(-shard).alias("k"))

    return (-F.array_max(F.array(*[score(k, w) for k, w in sorted(weights.items())]))["k"]).cast("int")


def assign(df: DataFrame, key_col: str = "doc_id", before: dict[int, float] | None = None, after: dict[int, float] | None = None) -> DataFrame:
    """(key, shard, shard_after, moved) for each row: one narrow projection over the key column."""
    key = F.col(key_col)
    placed = df.select(key.alias("doc_id"), shard_of(key, before or WEIGHTS).alias("shard"), shard_of(key, after or GROWN).alias("shard_after"))
    return placed.withColumn("moved", F.col("shard") != F.col("shard_after"))
