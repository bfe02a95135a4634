import hashlib
import random

import numpy as np
import pytest

from thematrail.llm.centroids import VantageTree, cluster_vectors

SCHEMA = "vec_id bigint, embedding array<float>, cluster string"


def brute(rows, k, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of every kept vector, by plain Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


@pytest.mark.parametrize("seed,spread,k", [(1, 1.0, 8), (2, 0.004, 8), (3, 1.0, 40)])
def test_clusters_equal_brute_force(spark, seed, spread, k):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(6)]) for i in range(200)]
    rows += [(i, list(v)) for i, v in rows[:40]]  # repeated rows
    rows += [(500, None), (501, [0.0] * 5), (502, [0.0] * 7), (503, [0.0] * 5 + [None]), (504, [0.0] * 5 + [float("nan")]), (505, [0.0] * 5 + [float("inf")]), (None, [0.0] * 6), (506, [0.0] * 6)]
    got = cluster_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), k, 5, 6).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, 5, 6)


def test_few_and_no_vectors(spark):
    three = [(i, [float(i)] * 4) for i in range(3)]
    docs = spark.createDataFrame([(*r, "x") for r in three], SCHEMA)
    assert sorted(tuple(r) for r in cluster_vectors(docs, 8, 3, 4).collect()) == brute(three, 8, 3, 4)
    empty = cluster_vectors(docs.limit(0), 8, 3, 4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_very_large_components_keep_distances_in_64_bits(spark):
    docs = spark.createDataFrame([(1, [3e38] * 4, "x"), (2, [-3e38] * 4, "x"), (3, [0.0] * 4, "x")], SCHEMA)
    assert {r.vec_id: r.distance for r in cluster_vectors(docs, 3, 2, 4).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("k", [1, 2, 3, 8, 60])
def test_the_tree_finds_the_nearest_and_prunes(k):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-4, 5, (k, 3)) if k < 60 else np.repeat(rng.integers(-900, 900, (30, 3)), 2, 0)  # many ties
    vectors = rng.integers(-5, 6, (500, 3)) if k < 60 else np.repeat(centroids, 10, 0) + rng.integers(-3, 4, (600, 3))
    number, best, compared = VantageTree(centroids).nearest(vectors.astype(np.int64))
    away = ((vectors[:, None, :] - centroids) ** 2).sum(2)
    assert (best == away.min(1)).all() and (number == away.argmin(1)).all()
    assert k < 60 or compared < 0.5 * len(vectors) * k


def test_query_equals_brute_force_on_the_given_vectors(spark):
    from thematrail.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.queries()["op12_vantage_centroids"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 8, 10, 64)
