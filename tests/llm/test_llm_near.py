import random
import re

import numpy as np
from pyspark.sql import functions as F

from thematrail.llm.collisions import near_vectors
from thematrail.llm.components import components
from thematrail.llm.setsketch import near_duplicates, shingle_sets, without_near_copies

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def least_members(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    run = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(words, len(run))
    return {tuple(run[i : i + n]) for i in range(len(run) - n + 1)} if n else set()


def brute(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(s), least_members(sets, links)[i]) for i, s in sets.items()}


def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"] + ["É", "Ü", "X"]
    rows, number = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.05]) else w for w in base]
            rows.append((number, rng.choice([" ", "\n", "\t "]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
            number += 1
    return [*rows, (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "ONE"), (9006, "x " * 30000), (9007, "X " * 29000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, n bigint, rep string")
    for words in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, words, 80).collect()}
        assert got == brute(rows, words, 80)
    kept = without_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows, 5, 80).values()})


def test_large_group_of_borderline_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        at = set(rng.sample(range(120), rng.randrange(0, 11)))
        rows.append((i, " ".join(f"v{i}{k}" if k in at else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "A b C")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(0, 2, None, None), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_shingle_hashes_are_as_many_as_shingles():
    rows = corpus()
    for words in (1, 2, 5):
        assert [len(s) for s in shingle_sets([(t or "").encode() for _, t in rows], words)] == [len(shingles(t, words)) for _, t in rows]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (300, 299), (299, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == least_members({n for link in links for n in link}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist(), int(rng.integers(3))))
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e200] * 16, [2e-200] * 16, [1.0] * 4]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[1][1], rows[1][2]), (2002, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, links int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, 0.93).collect()}
    assert len(got) == len(rows)
    good = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x), label
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    found = sum(n for n, _, _ in got.values())
    assert found <= 2 * len(links) and found >= 1.98 * len(links)
    least = least_members({r[0] for r in rows}, links)
    assert sum(got[i][1] != least[i] for i in got) <= 0.01 * len(got)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    assert near_vectors(df.limit(0)).count() == 0


def test_a_long_list_is_cut_into_parts(spark, monkeypatch):
    from thematrail.llm import collisions

    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(i, (base + 0.05 * rng.normal(size=24)).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = sorted(map(tuple, near_vectors(df).collect()))
    monkeypatch.setattr(collisions, "PART", 40)
    assert sorted(map(tuple, near_vectors(df).collect())) == whole
    assert whole[0][1] == 149


def test_outermost_in_blocks_equals_one_product_in_bounded_memory():
    import tracemalloc

    from thematrail.llm.collisions import DIRECTIONS, ENTRIES, _directions, outermost

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for projections in (ENTRIES, 1000, DIRECTIONS, 5 * DIRECTIONS - 7):
        whole = np.concatenate([_directions(16, b) for b in range(5)], axis=1)[:, :projections]
        at = vectors @ whole
        order = np.argsort(-np.abs(at), axis=1)[:, :ENTRIES]
        want = [sorted(zip(o * 2 + (a[o] < 0), np.abs(a[o]).astype(np.float32))) for o, a in zip(order, at)]
        lists, value = outermost(vectors, projections)
        assert [[x for x, _ in sorted(zip(r, v))] for r, v in zip(lists, value)] == [[x for x, _ in w] for w in want]
        assert np.allclose([[x for _, x in sorted(zip(r, v))] for r, v in zip(lists, value)], [[x for _, x in w] for w in want])
    peaks = []
    for projections in (16 * DIRECTIONS, 64 * DIRECTIONS):
        tracemalloc.start()
        outermost(vectors, projections)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
