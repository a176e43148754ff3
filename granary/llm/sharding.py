"""Sharding by rendezvous hashing: each record goes to the shard whose hash of (key, shard) wins.

Native: DataFrame functions only. A shard's chance is in proportion to its weight, and a shard more takes rows only
into itself, as no other shard's hash changes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import written

#: 60 bits of md5, as a number that Spark and SQL engines read alike.
_HEX_DIGITS, _SPAN = 15, float(1 << 60)


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX_DIGITS), 16, 10).cast("long")


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard of least -ln(u) / weight, u from the hash of "key:shard"; of equals, the lowest shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight over 0")
    scores = [
        F.struct((-F.log((hash60(F.concat(key, F.lit(f":{i}"))) + 0.5) / _SPAN) / float(w)).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def rendezvous_shards(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0, *, key: str = "doc_id", text: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """Shard, gapless slot in it, and the shard after one more of weight `grown` is added.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law ("key"), shard, slot, grown_shard.
    Null text counts as empty; a null key is one key of its own, "null"; rows of one key share a shard; repeated rows
    keep a slot each; an empty table gives none. Other columns are not read, whatever their names.

    Slots need no total order over a shard: rows fall by a second hash, of all that is returned, into buckets of about
    `bucket_rows`, are numbered in their bucket, and start at the sum of the buckets before. Rows that are alike share that
    hash; where they are over `bucket_rows` and over a 1,000th of all rows, row numbers deal them over buckets of their own.
    Only ids, sizes and hashes are shuffled, never texts.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(key).alias("id"), name.alias("name"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = slim.select(
        "id", "size", "text_crc32", winner(F.col("name"), weights).alias("shard"),
        (winner(F.col("name"), [*weights, grown]) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        hash60(F.concat_ws("#", F.col("name"), F.col("text_crc32"), F.col("size"))).alias("place"), F.monotonically_increasing_id().alias("row"),
    )
    placed = written(placed, "sharding")
    total = placed.count()
    bits = max(0, math.ceil(math.log2(max(1, total / (bucket_rows * len(weights))))))
    hot = placed.groupBy("place").agg(F.count("*").alias("alike")).filter(F.col("alike") > max(bucket_rows, total / 1000))  # under 1,000 places
    placed = placed.join(F.broadcast(hot), "place", "left").withColumn("bucket", F.shiftright("place", 60 - bits).cast("int"))
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("alike") / bucket_rows)).cast("int") + 1
    placed = placed.withColumn("own", F.when(F.col("alike").isNull(), F.lit(-1)).otherwise(F.col("place"))).withColumn("part", F.coalesce(part, F.lit(0)))
    cell = ["bucket", "own", "part"]
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", *cell).agg(F.count("*").alias("n")).select("shard", *cell, F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", *cell).orderBy("place", "id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["shard", *cell])
        .select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )
