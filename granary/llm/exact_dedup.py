"""Exact dedup by a tree merge of sorted digest runs.

Each input partition makes a sorted run of (digest, best identifier, count). In every binomial round the partitions
that differ in the same bits of their number exchange the parts of their runs which the other owns, merge what arrives,
and keep one verified best identifier a digest. After the last round each partition holds the whole of its own share of
the digests, so no run of all documents is ever made, and a group of any size has shrunk to a row a partition before
the first exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import trimmed, written

WHITE = r"[\x20\x09-\x0D]"
_RUN = "digest binary, check long, best_len long, best_id {}, n long, owner int, at int"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, check) to one row for each; a group may span batches, so the last is carried over."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows.cast(held.schema)]).combine_chunks() if held is not None else rows
        rows = _best(rows)
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            yield from rows.slice(0, rows.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _best(rows: pa.Table) -> pa.Table:
    """Of adjacent rows with equal digest and check: longest, then smallest id, and the sum of the counts."""
    digest = rows.column("digest").combine_chunks()
    width = np.frombuffer(digest.buffers()[2], np.uint8)
    offsets = np.frombuffer(digest.buffers()[1], np.int32)[digest.offset : digest.offset + len(digest) + 1]
    if len(digest) and not (np.diff(offsets) == 32).all():
        raise ValueError("a digest has 32 bytes")
    bits = width[offsets[0] : offsets[-1]].reshape(-1, 32)
    check, length, n = (rows.column(c).to_numpy() for c in ("check", "best_len", "n"))
    ident = pc.rank(rows.column("best_id").combine_chunks(), null_placement="at_end", tiebreaker="dense").to_numpy()
    new = np.ones(len(check), bool)
    new[1:] = (check[1:] != check[:-1]) | (bits[1:] != bits[:-1]).any(axis=1)
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    order = np.lexsort((ident, -length, group))[first]
    out = rows.take(pa.array(order))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(n, first)))


def digest_groups(docs: DataFrame, partitions: int | None = None, fan_in_bits: int = 2) -> DataFrame:
    """One row for each normalised text: digest, check, best_id, n.

    docs: doc_id, digest (32 bytes), check (length and a second hash of the same text, so that a group is verified by
    two independent hashes), best_len. partitions: a power of 2. fan_in_bits: 2**bits runs meet in a merge.
    """
    spark = docs.sparkSession
    wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (max(1, wanted) - 1).bit_length())
    size = 1 << bits
    high = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = docs.select(
        "digest", "check", "best_len", F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("n"),
        F.shiftright(high, 32 - bits).cast("int").alias("owner") if bits else F.lit(0).alias("owner"),
        F.pmod(F.spark_partition_id(), F.lit(size)).cast("int").alias("at"),
    )
    run = _RUN.format(docs.schema["doc_id"].dataType.simpleString())
    runs = runs.sortWithinPartitions("digest", "check").mapInArrow(trimmed(_merge), run)
    for low in range(0, bits, fan_in_bits):
        mask = ((1 << min(fan_in_bits, bits - low)) - 1) << low
        there = F.col("at").bitwiseAND(~mask & (size - 1)).bitwiseOR(F.col("owner").bitwiseAND(mask))
        runs = runs.withColumn("at", there).repartitionById(size, F.col("at")).sortWithinPartitions("digest", "check").mapInArrow(trimmed(_merge), run)
    return (runs if bits else runs.coalesce(1).sortWithinPartitions("digest", "check").mapInArrow(trimmed(_merge), run)).select("digest", "check", "best_id", "n")


def text_digest(text: str = "text") -> Column:
    """Lowercase hex of the normalised text's SHA-256; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, ""), 256)


def exact_dedup(docs: DataFrame, *, text: str = "text", partitions: int | None = None, hot_share: float = 0.001) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space; null counts as empty, and empty texts are one group.
    The row with the most code points in the original stays, then the smallest doc_id (of any type that sorts), a null id last. Rows that repeat
    an id are all counted, and all are kept where that id stays. An empty table gives no rows; other columns are not read.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    marked = (
        docs.select("doc_id", F.length(raw).cast("long").alias("best_len"), F.regexp_replace(raw, WHITE, "").alias("bare"))
        .select("doc_id", "best_len", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"))
    )
    marked = written(marked, "digests")
    groups = written(digest_groups(marked, partitions), "groups")
    keys = ["digest", "check"]
    # A digest with over hot_share of all rows: at most 1 / hot_share of them, so these few may be broadcast.
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.filter(F.col("n") > max(1.0, hot_share * total))
    hot = hot.select(*keys, F.col("best_id").alias("hot_id"), F.col("n").alias("hot_n"))
    rows = marked.join(F.broadcast(hot), keys, "left")
    found = rows.filter(F.col("hot_n").isNotNull()).select("doc_id", *keys, F.col("hot_id").alias("keep_id"), F.col("hot_n").alias("group_size"))
    rest = rows.filter(F.col("hot_n").isNull()).select("doc_id", *keys).join(groups.select(*keys, F.col("best_id").alias("keep_id"), F.col("n").alias("group_size")), keys)
    return found.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
