"""Centroid clustering by exponion search, exact over integer vectors.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to any other.
Where the bounds do not settle the centroid, only centroids inside a ball around the current one are compared: those at
most twice the upper bound plus the gap to its nearest neighbour away, read off its sorted list of neighbours. The ball
is inclusive and bounds are rounded outwards, so ties are always compared; distances are exact integers.

Vectors are never shuffled: a round is a pass of tasks that write vectors with their bounds, then sums by cluster with
partial aggregation. Only centroids (k vectors) pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import trimmed, written

#: Components are held within this, so that a squared distance of 2**13 components fits a long.
MOST = 1 << 24
#: A bound on centroids: their table of gaps, 8 bytes a pair, is held by every task.
MOST_CENTROIDS = 4096
#: Bounds are rounded outwards by this share, far over the error of a float64 square root.
_SLACK = 1e-9
#: Up to this size float64 products and their sums over 2**9 components are exact.
_FLOAT_EXACT = 1 << 20
_ROWS = 4096


def integer_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, vector (ints): floor(scale * x) of every row whose vector has exactly `size` finite components.

    A null vector, a null, NaN or infinite component or another length drops the row. Components beyond 2**24 after
    scaling count as that. Repeated and null ids are rows of their own; other columns are not read.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * F.lit(float(scale))))).cast("int"))
    return rows.filter((F.size(vector) == size) & finite).select(F.col(vec_id).alias("vec_id"), whole.alias("vector"))


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64, of each row (int32) from each centroid (int64)."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if top <= _FLOAT_EXACT and rows.shape[1] <= 512:
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    x = rows.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1) if len(centroids) else np.zeros((len(x), 0), np.int64)


class Search:
    """Centroids with each one's sorted list of the others."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = np.sqrt(np.concatenate([squared(centroids[i : i + 256], centroids) for i in range(0, len(centroids), 256)]).astype(np.float64))
        np.fill_diagonal(gaps, -1.0)  # itself stands first, before any centroid in the same place
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.maximum(np.take_along_axis(gaps, self.order, axis=1), 0.0)
        self.nearest = self.gaps[:, 1] if len(centroids) > 1 else np.full(1, np.inf)

    def compared(self, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest of the numbered centroids (of equals the smaller number), its squared distance, and the second least one."""
        far = squared(rows, self.centroids[numbers])
        best = far.min(1)
        which = np.where(far == best[:, None], numbers[None, :], len(self.centroids)).min(1)
        second = np.partition(far, 1, axis=1)[:, 1].astype(np.float64) if len(numbers) > 1 else np.full(len(rows), np.inf)
        return which, best, second

    def settle(self, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Puts right cluster, upper and lower, in place; the number of distances that it took.

        A cluster of -1 has no bounds yet and is compared with all centroids.
        """
        taken = 0

        def put(at: np.ndarray, numbers: np.ndarray) -> None:
            nonlocal taken
            for lo in range(0, len(at), _ROWS):
                some = at[lo : lo + _ROWS]
                cluster[some], best, second = self.compared(rows[some], numbers)
                upper[some] = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
                lower[some] = np.sqrt(second) * (1 - _SLACK)
                taken += len(some) * len(numbers)

        put(np.flatnonzero(cluster < 0), np.arange(len(self.centroids)))
        open_ = np.flatnonzero(upper >= lower)
        upper[open_] = np.sqrt(self.own(rows[open_], cluster[open_]).astype(np.float64)) * (1 + _SLACK)
        taken += len(open_)
        open_ = open_[upper[open_] >= lower[open_]]
        for a in np.unique(cluster[open_]):
            at = open_[cluster[open_] == a]
            inside = np.searchsorted(self.gaps[a], (2 * upper[at] + self.nearest[a]) * (1 + _SLACK), "right")
            # Rings of the list double in size: what lies in one ring is compared together.
            ring = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), len(self.centroids))
            for n in np.unique(ring):
                put(at[ring == n], self.order[a][:n])
        return taken

    def own(self, rows: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows from their own centroids."""
        found = np.empty(len(rows), np.int64)
        for lo in range(0, len(rows), _ROWS):
            found[lo : lo + _ROWS] = ((rows[lo : lo + _ROWS].astype(np.int64) - self.centroids[cluster[lo : lo + _ROWS]]) ** 2).sum(1)
        return found


def moved(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], steps: np.ndarray) -> None:
    """Loosens (cluster, upper, lower) in place by how far each centroid went."""
    cluster, upper, lower = bounds
    upper += steps[cluster]
    top = int(np.argmax(steps))
    others = np.delete(steps, top).max(initial=0.0)
    lower -= np.where(cluster == top, others, steps[top])


def _assigned(centroids: np.ndarray, steps: np.ndarray | None, last: bool):
    """A round for mapInArrow: rows with vector, and from the second round on with bounds, get their cluster and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if steps is None:
                cluster, upper, lower = np.full(n, -1, np.int64), np.zeros(n), np.full(n, np.inf)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper, lower = batch.column("upper").to_numpy().copy(), batch.column("lower").to_numpy().copy()
                moved((cluster, upper, lower), steps)
            search.settle(rows, cluster, upper, lower)
            numbers = pa.array(cluster.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), numbers, pa.array(search.own(rows, cluster))], ["vec_id", "cluster", "distance"])
            else:
                arrays = [batch.column("vec_id"), batch.column("vector"), numbers, pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "cluster", "upper", "lower"])

    return trimmed(run)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """Vectors of the k ids with the smallest SHA-256 of "seed:id" as centroids; of one id's rows, by their components. A null id is "null"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([row["vector"] for row in found], np.int64)


def exponion_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, *, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row of vectors, and the centroids it was assigned by.

    vectors: vec_id of any type, vector as an array of ints, all of one length. Each round assigns every vector to its
    nearest centroid (of equals the smaller number) and puts each centroid that has vectors at floor(sum / count) of each
    component; then all are assigned once more. distance is squared. Fewer than k rows are as many centroids; an empty
    table gives none. Rows that repeat, wholly or in their id, are assigned each.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"between 1 and {MOST_CENTROIDS} centroids")
    centroids = first_centroids(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType
    fields = [T.StructField("vec_id", kind), T.StructField("vector", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType())]
    between = T.StructType([*fields, T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])
    after = T.StructType([fields[0], fields[2], T.StructField("distance", T.LongType())])
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], after), centroids
    state, steps = vectors, None
    for _ in range(rounds):
        state = written(state.mapInArrow(_assigned(centroids, steps, False), between), "exponion")
        sums = [F.sum(F.get("vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
        after_round = centroids.copy()
        for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
            after_round[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
        steps = np.sqrt(((after_round - centroids) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        centroids = after_round
    return written(state.mapInArrow(_assigned(centroids, steps, True), after), "clusters"), centroids


def with_inertia(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """clusters with cluster_inertia, inertia and centroid_sha256 (of the components as decimal integers, comma-joined)."""
    found = {row["cluster"]: row["s"] for row in clusters.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    whole = sum(found.values())
    named = [(i, s, whole, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sorted(found.items())]
    table = clusters.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
