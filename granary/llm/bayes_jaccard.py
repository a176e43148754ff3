"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Each text becomes a set of word shingles, a hash of that set, and MinHash values. Texts with equal sets are one node.
2. Nodes that agree in a band of MinHash values share a bucket. In a bucket's blocks, values are compared a few at a time;
   a pair goes as soon as the posterior probability that its similarity reaches the threshold falls below a tolerance.
   What is left ties nodes into clusters; of it, only a spanning forest leaves the block.
3. The sets of clustered nodes meet in blocks of their cluster, where every pair is verified exactly. A block sends the
   number of links of each node and again a spanning forest, never the pairs.
4. Classes are the components of these forests.

A bucket or cluster larger than a block, in rows or in bytes of its sets, is cut by hash into parts, and each two parts
meet in a task, so no task holds more than two parts and no link is lost. n_links is exact, so the n different texts of
one cluster of near copies are all compared: n squared pairs in blocks, and n / `block` copies of each set in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SOLID, Spans, components, join_groups, mix64, text_slabs, trimmed, whole_groups, words, written

WORDS = 5
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all texts' word shingles, sorted within a text, and each text's first.

    Words are runs without ASCII white space, as they are. A text of fewer words, but one at least, has one shingle of
    all its words; a text without words has none.
    """
    starts, ends, first = words(data, offsets, SOLID)
    own = Spans(data).hash(starts, ends)
    count = np.diff(first)
    value = np.zeros(len(own), np.uint64)
    place = np.arange(len(own)) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - place
    size = np.minimum(np.repeat(count, count), width)
    for j in range(width):
        at = np.minimum(np.arange(len(own)) + j, max(0, len(own) - 1))
        value = np.where(j < size, mix64(value * _MIX + own[at]), value)
    keep = left >= size
    row, value = np.repeat(np.arange(len(count)), count)[keep], value[keep]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def min_hashes(value: np.ndarray, first: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """(texts, size) of uint32; texts without shingles have the greatest value throughout."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 62, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    n = len(first) - 1
    out = np.full((size, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        for k in range(size):
            mixed = value * factors[k] + shifts[k]
            out[k, some] = np.minimum.reduceat(((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32), first[:-1][some])
    return np.ascontiguousarray(out.T)


def set_hash(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, of two mixes of its members."""
    out = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value ^ salt))])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def least_matches(threshold: float, tolerance: float, size: int, step: int) -> list[int]:
    """After each `step` values compared: the fewest matches with which P(similarity >= threshold) is still at least `tolerance`.

    The prior of the similarity is uniform, so the posterior of m matches in n is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(step, size + 1, step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() >= tolerance * mass.sum():
                break
        out.append(m)
    return out


def pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of places with equal values of a sorted array."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    count = end - np.arange(n) - 1
    i = np.repeat(np.arange(n), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is linked to by pairs (i, j), over any path."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pieces(group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of a sorted array with some `most` pairs each."""
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    size = np.diff(edges)
    total = np.cumsum(size * (size - 1) // 2)
    lo = done = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield int(edges[lo]), int(edges[hi])
        lo, done = hi, int(total[hi - 1])


def _parts(rows: DataFrame, key: Column, node: Column, parts: Column) -> DataFrame:
    """Each row once for each block that it meets others in: its own part with itself and with every other part of its group."""
    parts = F.greatest(F.lit(1), F.ceil(parts)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit("part")), parts).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("block", F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other"))).withColumn("crossed", F.col("part") != F.col("other"))


_SKETCH = "rid long, doc_id {}, n long, set_a long, set_b long, sketch binary"


def jaccard_classes(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6, bands: int = 24, rows: int = 4, step: int = 16, block: int = 512, block_bytes: int = 16 << 20, filter_bits: int = 1 << 24) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_shingles, stays, rid.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of `threshold` or more, copies included;
    class_id is the least doc_id that is linked to the row over any path of links, and stays marks that row. A text without words (null, empty or
    white space) has no links and is a class of its own. Repeated rows count as copies of each other. A null doc_id
    counts as less than any other in a class. An empty table gives no rows; other columns are not read.

    A pair at the threshold shares no band with probability (1 - threshold**rows)**bands, 3e-6 by default; a true pair is
    pruned with a probability of about `tolerance` a step.
    """
    spark = docs.sparkSession
    size = bands * rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(row_id(text).alias("rid"), "doc_id", F.col(text).alias("text_"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slabs(batch.column(2)):
                value, first = shingles(data, offsets)
                a, b = set_hash(value, first)
                found = min_hashes(value, first, size)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), hi - lo, [None, pa.py_buffer(found)]).cast(pa.binary())
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(2)] + [pa.array(np.diff(first), pa.int64()), pa.array(a), pa.array(b), flat]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n", "set_a", "set_b", "sketch"])

    sketched = written(source.mapInArrow(trimmed(sketch), _SKETCH.format(kind)), "sketch")
    keys = ["set_a", "set_b"]
    nodes = sketched.filter("n > 0").groupBy(*keys).agg(
        F.min("rid").alias("node"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid")).alias("least"), F.first("sketch").alias("sketch"), F.first("n").alias("n")
    )
    nodes = written(nodes, "nodes")
    n_nodes = nodes.count()

    # Buckets of two nodes or more, in blocks.
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (4 * rows) + 1, F.lit(4 * rows)))))
    in_band = nodes.select("node", cut.alias("band", "bucket"))
    shared = written(in_band.groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1"), "buckets")
    members = join_groups(in_band.drop("band"), shared, ["bucket"], "count", bands * n_nodes)
    placed = _parts(members, F.col("bucket"), F.col("node"), F.col("count") / block).select("block", "crossed", "part", "node")
    placed = placed.join(nodes.select("node", "sketch"), "node").repartition("block").sortWithinPartitions("block")
    fewest = least_matches(threshold, tolerance, size, step)

    def close(values: np.ndarray, lo: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are left once all values are compared, `step` at a time."""
        matches = np.zeros(len(i), np.int64)
        for at, least in zip(range(0, size, step), fewest, strict=True):
            matches += (values[lo + i, at : at + step] == values[lo + j, at : at + step]).sum(axis=1)
            ok = matches >= least
            i, j, matches = i[ok], j[ok], matches[ok]
        return i, j

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, node, part = (table.column(c).to_numpy() for c in ("block", "node", "part"))
            crossed = np.asarray(table.column("crossed")).astype(bool)
            values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, size)
            for lo, hi in _pieces(group, 400_000):
                i, j = pairs_within(group[lo:hi])
                ok = ~crossed[lo + i] | (part[lo + i] != part[lo + j])
                i, j = i[ok], j[ok]
                kept = [close(values, lo, i[at : at + 50_000], j[at : at + 50_000]) for at in range(0, len(i), 50_000)]
                label = forest(hi - lo, *(np.concatenate([np.zeros(0, np.int64), *(x[side] for x in kept)]) for side in (0, 1)))
                moved = np.flatnonzero(label != np.arange(hi - lo))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][moved]), pa.array(node[lo:hi][label[moved]])], ["a", "b"])

    edges = placed.select("block", "crossed", "part", "node", "sketch").mapInArrow(trimmed(prune), "a long, b long").filter("a <> b")
    clusters = components(edges, "clusters")
    clustered = written(nodes.select("node", *keys, "copies", "n").join(clusters, "node"), "clustered")
    parts = clustered.groupBy("label").agg(F.count("*").alias("count"), F.greatest(F.count("*") / block, 8 * F.sum("n") / block_bytes).alias("wanted"))
    sized = join_groups(clustered, parts, ["label"], "count", clustered.count())
    placed = written(_parts(sized, F.col("label"), F.col("node"), F.col("wanted")).select("node", *keys, "copies", "block", "crossed", "part"), "placed")

    # The sets of the clustered nodes: a filter of fixed size lets through few other texts, which the join then drops.
    wanted = _filter(placed.select("node").distinct(), filter_bits)
    shared_bits = spark.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for lo, hi, data, offsets in text_slabs(batch.column(1)):
                value, first = shingles(data, offsets)
                a, b = set_hash(value, first)
                raw = pa.array([value[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rid[lo:hi]), pa.array(a), pa.array(b), raw], ["node", *keys, "members"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared_bits.value
        for batch in batches:
            rid = mix64(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(8 * len(bits))
            hit = bits[(rid >> np.uint64(3)).astype(np.int64)] >> (rid & np.uint64(7)).astype(np.uint8) & 1
            kept = batch.filter(pa.array(hit.astype(bool)))
            if kept.num_rows:
                yield from sets(iter([kept]))

    found = source.select("rid", "text_").mapInArrow(trimmed(likely), "node long, set_a long, set_b long, members binary")
    found = found.join(placed.select("node", *keys).distinct(), ["node", *keys], "left_semi").dropDuplicates(["node"])
    whole = placed.join(found.select("node", "members"), "node").select("block", "crossed", "part", "node", "copies", "members")
    whole = whole.repartition("block").sortWithinPartitions("block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, node, part, copies = (table.column(c).to_numpy() for c in ("block", "node", "part", "copies"))
            crossed = np.asarray(table.column("crossed")).astype(bool)
            members = table.column("members").combine_chunks()
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in members.slice(lo, hi - lo)]
                linked = similar(sets, threshold)
                if crossed[lo]:
                    linked &= part[lo:hi, None] != part[None, lo:hi]
                links = linked @ copies[lo:hi].astype(np.int64)
                label = forest(hi - lo, *np.nonzero(np.triu(linked)))
                own = node[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[label]), pa.array(links, pa.int64())], ["a", "b", "links"])

    verified = written(whole.mapInArrow(trimmed(verify), "a long, b long, links long"), "links")
    labels = components(verified.filter("a <> b").select("a", "b"), "classes")
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = written(labels.join(nodes.select("node", "least"), "node"), "labelled")
    heads = labelled.groupBy("label").agg(F.count("*").alias("count"), F.min("least").alias("head"))
    heads = join_groups(labelled.select("node", "label"), heads, ["label"], "count", labelled.count()).select("node", "head")
    named = nodes.join(heads, "node", "left").join(links, "node", "left")
    named = written(named.select(*keys, "copies", F.coalesce("head", "least").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    total = sketched.count()
    slim = sketched.filter("n > 0").select("rid", "doc_id", "n", *keys)
    out = join_groups(slim, named, keys, "copies", total)
    out = out.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links", F.col("n").alias("n_shingles"), (F.col("least.rid") == F.col("rid")).alias("stays"), "rid")
    alone = sketched.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), F.lit(True).alias("stays"), "rid")
    return out.unionByName(alone)


def row_id(text: str = "text") -> Column:
    """The hash of id and text by which jaccard_classes names a row, as `rid`.

    It has 64 bits: of 5e10 different rows some 70 pairs share one, and each such pair counts as one row, or as one node.
    """
    return F.xxhash64("doc_id", text)


def similar(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """(n, n) of whether the Jaccard similarity reaches the threshold, exactly; False on the diagonal."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(n), size)
    value, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # others are in one set alone
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float64)
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    union = size[:, None] + size[None] - both
    linked = both >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _filter(nodes: DataFrame, bits: int, parts: int = 16) -> np.ndarray:
    """A bit for each hash modulo `bits`; the bits, a fixed number, are put together in `parts` tasks."""
    span = bits // parts
    at = lambda key: mix64(key.view(np.uint64)) % np.uint64(bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = at(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((where // np.uint64(span)).astype(np.int32)), pa.array(where.astype(np.int64))], ["part", "bit"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part):
                own.setdefault(int(p), np.zeros(span, bool))[bit[part == p] - int(p) * span] = True
        for p, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    found = nodes.mapInArrow(place, "part int, bit long").distinct().repartition(parts, "part").mapInArrow(build, "part int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in found:
        out[row["part"] * span // 8 : (row["part"] + 1) * span // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def expected_recall(threshold: float, bands: int, rows: int) -> float:
    """Of pairs exactly at the threshold: the share that some band brings together."""
    return 1 - math.pow(1 - threshold**rows, bands)
