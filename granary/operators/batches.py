"""Epoch order, batches, cursors and horizons over numbered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Blocks that one task ranks.
BUCKET_ROWS = 1 << 18


def epoch_order(blocks: DataFrame, seed: int, epoch: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """block_id and its rank in an order that seed + epoch alone decide.

    The order is that of a digest; as many of its first digits as make about `bucket_rows` blocks a bucket part the blocks,
    and ranks are counted in each bucket from the sum of the buckets before, so no task sorts all blocks.
    """
    total, digits = blocks.count(), 0
    while digits < 15 and total > bucket_rows * 16**digits:
        digits += 1
    keyed = blocks.select("block_id", F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col("block_id").cast("string")).cast("binary")).alias("digest"))
    keyed = keyed.withColumn("bucket", F.substring("digest", 1, digits))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over buckets, not blocks
    starts = keyed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "block_id"))
    return keyed.withColumn("inside", inside).join(starts, "bucket").select("block_id", (F.col("start") + F.col("inside") - 1).cast("long").alias("rank"))


def train_batches(blocks: DataFrame, batch: int, seed: int, epoch: int, start_batch: int = 0) -> DataFrame:
    """epoch, batch_id, slot, block_id of whole batches from start_batch on; the tail of the epoch is dropped."""
    total = blocks.count()
    if not 0 <= start_batch <= total // batch:
        raise ValueError(f"start_batch must be from 0 to {total // batch}")
    at = F.floor(F.col("rank") / batch).cast("long")
    return (
        epoch_order(blocks, seed, epoch)
        .select(F.lit(epoch).alias("epoch"), at.alias("batch_id"), (F.col("rank") % batch).cast("int").alias("slot"), "block_id")
        .filter((F.col("batch_id") < total // batch) & (F.col("batch_id") >= start_batch))
    )


def validation_batches(blocks: DataFrame, batch: int, steps: int | None = None) -> DataFrame:
    """batch_id, slot, block_id in order; the last batch may be short."""
    rows = blocks.select(F.floor(F.col("block_id") / batch).cast("long").alias("batch_id"), (F.col("block_id") % batch).cast("int").alias("slot"), "block_id")
    return rows if steps is None else rows.filter(F.col("batch_id") < steps)


def horizon(blocks: int, batch: int, accumulation: int, epochs: int, max_steps: int | None = None) -> tuple[int, int]:
    """Updates an epoch, and in all."""
    each = blocks // batch // accumulation
    if each < 1:
        raise ValueError("the data is too small for one optimizer step")
    total = each * epochs
    return each, min(total, max_steps) if max_steps else total


def weighted_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean loss a token over (loss_sum, tokens) rows; never the mean of means."""
    return batch_losses.agg((F.sum("loss_sum") / F.sum("tokens")).alias("loss"), F.sum("tokens").cast("long").alias("tokens"))
