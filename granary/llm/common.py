"""What the operators of this subpackage share: tables, folds, shared folders and a byte-level word kernel."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
SLAB_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text alone, so that nothing else is read from Parquet."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def fold(column: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder.

    Where neither is set, one of the machine's own serves a local master, and any other is an error: executors would
    write to disks of their own.
    """
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again with df's schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """run for mapInArrow, after which the worker gives freed memory back to the system: workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def text_slabs(texts: pa.Array, max_bytes: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0) of runs of at most `max_bytes`, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLAB_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


class Spans:
    """Hashes of any spans of one slab of bytes, from one running sum (a polynomial modulo 2**64)."""

    def __init__(self, data: np.ndarray, byte_map: np.ndarray | None = None):
        codes = _CODES if byte_map is None else _CODES[byte_map]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _power("up", len(data)), out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = _power("down", len(self.sums))[starts]
        return mix64((self.sums[ends] - self.sums[starts]) * at + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `is_word` (256 booleans) has, cut at the texts' bounds, and each text's first word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if len(cuts := offsets[1:-1]):
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def byte_class(holds) -> np.ndarray:
    return np.array([bool(holds(x)) for x in range(256)])


#: Bytes that are not ASCII white space.
SOLID = byte_class(lambda x: x != 32 and not 9 <= x <= 13)
#: ASCII letters and digits, and every byte of a longer code point.
ALNUM = byte_class(lambda x: x >= 128 or chr(x).isalnum())
#: A-Z to a-z.
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by `key`; a group that spans batches is held until it ends."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        same = not held or held[-1].column(key)[-1].as_py() == keys[0]
        if not same:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if not len(change):
            held.append(rows)
            continue
        cut = int(change[-1]) + 1
        yield pa.concat_tables([*held, rows.slice(0, cut)]).combine_chunks()
        held = [rows.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: float = 0.001, how: str = "inner") -> DataFrame:
    """rows join groups on keys, where `size` counts a group's rows: groups of over `share` of all rows, at most 1 / share of them, are broadcast."""
    large = groups.filter(F.col(size) > max(1.0, share * total))
    hot = rows.join(F.broadcast(large), keys)
    cold = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= max(1.0, share * total)), keys, how)
    return hot.unionByName(cold)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label of every node in edges (a, b): all nodes that any path links have one label, one of theirs.

    Each round gives a node its least neighbour, if that is less, and puts it in the node's place in all edges; equal edges
    become one, and a star of any size is gone after a round. The parents of each round, written to the shared folder, are
    then followed back. Only nodes are shuffled, those that a large share of all edges or parents name are broadcast
    (join_groups), and nothing but the number of edges comes to the driver. Names should be hashes: in their random order a
    path of n nodes takes some log n rounds, in its own order n.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    parents = []
    while left := edges.count():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        parent = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.count("*").alias("degree"))
        parent = written(parent.select("node", F.least("node", "b").alias("parent"), "degree"), f"{name}-parents")
        parents.append(parent.select("node", "parent"))
        moved = join_groups(edges, parent.select(F.col("node").alias("a"), F.col("parent").alias("c"), "degree"), ["a"], "degree", left).drop("degree")
        moved = join_groups(moved, parent.select(F.col("node").alias("b"), F.col("parent").alias("d"), "degree"), ["b"], "degree", left).filter("c <> d")
        edges = written(moved.select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).distinct(), f"{name}-edges")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = parents.pop().withColumnRenamed("parent", "label")
    while parents:
        own = parents.pop()
        above = own.groupBy("parent").agg(F.count("*").alias("named")).join(labels.withColumnRenamed("node", "parent"), "parent", "left")
        above = written(above.select("parent", "named", F.coalesce("label", "parent").alias("label")), f"{name}-above")
        labels = join_groups(own, above, ["parent"], "named", own.count()).select("node", "label")
    return written(labels, f"{name}-labels")
