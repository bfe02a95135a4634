"""Centroid clustering with a vantage-point tree over the centroids.

Vectors are turned into integers, so that distances, sums and means are exact and every run gives the same
clusters. Each round builds a vantage-point tree of the few centroids, broadcasts it (bounded: k centroids), finds the nearest centroid of
every vector by best-first branch-and-bound in the tasks, adds the vectors of each cluster up per task and replaces the
centroids by floored means. Vectors are written once and only read after that; what a round moves is one row per task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Scale of the integer components, and the bound at which they stop growing, so that squared distances fit in 64 bits.
SCALE, BOUND = 1024, 1 << 27

#: Centroids in a leaf of the tree.
LEAF = 2

#: Vectors that a task compares at a time.
ROWS = 4096


class VantageTree:
    """Nearest centroid under squared Euclidean distance, the smaller number among equals.

    A node holds a vantage point (itself a centroid) and two halves of the other centroids, those nearer to it and those farther, with the least and largest distance
    of each half. The triangle inequality bounds the distance from a vector to a half from below; a half is entered unless that
    bound is above the best distance found, so a half that could hold an equally near centroid is always entered. Bounds are
    taken a little too low to stay safe in floating point; distances that decide are integers.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.nodes: list[tuple[list[int], list[tuple[int, float, float]]]] = []  # centroids to compare with; halves as (node, least, largest)
        if len(centroids):
            self._build(list(range(len(centroids))))

    def _distances(self, numbers: Sequence[int], point: int) -> np.ndarray:
        return np.sqrt(((self.centroids[numbers] - self.centroids[point]) ** 2).sum(axis=1).astype(np.float64))

    def _build(self, numbers: list[int]) -> int:
        place = len(self.nodes)
        if len(numbers) <= LEAF:
            self.nodes.append((numbers, []))
            return place
        self.nodes.append(([], []))
        spread = [self._distances(numbers, p).std() for p in numbers]  # the point that tells the others apart best
        vantage = numbers[int(np.argmax(spread))]
        others = [n for n in numbers if n != vantage]
        away = self._distances(others, vantage)
        order = np.argsort(away, kind="stable")
        halves = []
        for half in np.array_split(order, 2):
            if len(half):
                halves.append((self._build([others[k] for k in half]), float(away[half].min()), float(away[half].max())))
        self.nodes[place] = ([vantage], halves)
        return place

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many distances were worked out.

        Every vector has its own queue of nodes; in each step all vectors that still have a promising node take their most
        promising one, and those that took the same node are worked on together.
        """
        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, -1, np.int32)
        queue = np.full((n, len(self.nodes)), np.inf)  # lower bounds of distances in the nodes that wait
        queue[:, 0] = 0
        going, compared = np.arange(n), 0
        while len(going):
            node = queue[going].argmin(axis=1)
            bound = queue[going, node]
            low = np.maximum(bound * (1 - 1e-9) - 1e-6, 0)
            open_ = np.isfinite(bound) & (low * low <= best[going])
            going, node = going[open_], node[open_]
            queue[going, node] = np.inf
            for k in np.unique(node):
                rows = going[node == k]
                numbers, halves = self.nodes[k]
                for c in numbers:
                    gap = vectors[rows] - self.centroids[c]
                    away = np.einsum("ij,ij->i", gap, gap)
                    compared += len(rows)
                    nearer = (away < best[rows]) | ((away == best[rows]) & (c < number[rows]))
                    best[rows[nearer]], number[rows[nearer]] = away[nearer], c
                if halves:
                    root = np.sqrt(away.astype(np.float64))
                    for half, least, largest in halves:
                        queue[rows, half] = np.maximum(np.maximum(root - largest, least - root), 0)
        return number, best, compared


def _whole(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], tree, dim: int) -> Iterator[pa.RecordBatch]:
    """Per task and cluster the number of vectors and the sum of each component."""
    k = len(tree.value.centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            vectors = _whole(batch.column("whole").slice(start, ROWS), dim)
            number, _, _ = tree.value.nearest(vectors)
            counts += np.bincount(number, minlength=k)
            for c in np.flatnonzero(np.bincount(number, minlength=k)):
                sums[c] += vectors[number == c].sum(axis=0)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], tree, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            number, away, _ = tree.value.nearest(_whole(part.column("whole"), dim))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number), pa.array(away)], names=["vec_id", "cluster", "distance"])


def whole_vectors(vectors: DataFrame, dim: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, whole): vectors with exactly ``dim`` components, none null or non-finite, as floor(1024 x) of each component."""
    values = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.filter((F.size(values) == dim) & F.forall(values, finite))
    # the bound is taken on the double: floor of a very large one would not fit the integer
    scaled = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("whole"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Clusters of the vectors of ``whole_vectors``; the others are left out.

    One row per vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia and inertia (distances summed over
    its cluster and over all), centroid_sha256 (of the centroid's components in decimal, joined by commas). Centroids 0, 1, ... start
    as the k vectors with the smallest SHA-256 of ``seed:vec_id``; in each round every vector goes to its nearest centroid (the smaller number
    of equals) and every centroid with vectors becomes the floored mean of their components. A null id counts as
    the empty word in the hash, equal ids go by their components. Fewer than k vectors give as many centroids,
    none at all gives no row; repeated rows count each. Components beyond +-2^17 count as that, so that distances fit in 64 bits.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, dim, vec_id, embedding), "whole-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "whole").orderBy("key", "whole").limit(k).collect()  # k rows
    centroids = np.array([r.whole for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        parts = rows.select("whole").mapInArrow(lambda batches, tree=tree: _sums(batches, tree, dim), "cluster int, n bigint, sums array<bigint>")
        exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dim)]
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # at most k rows
            centroids[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dim)]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    found = rows.mapInArrow(lambda batches: _assigned(batches, tree, dim), "vec_id bigint, cluster int, distance bigint") if len(centroids) else rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance")
    found = written(found, "clusters")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # at most k rows
    whole = sum(int(r.total) for r in inertia)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shown = [(int(r.cluster), int(r.total), whole, digests[r.cluster]) for r in inertia]
    table = spark.createDataFrame(shown, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
