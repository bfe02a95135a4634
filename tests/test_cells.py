import numpy as np
import pytest
from pyspark.sql import functions as F

from thematrail.operators import cells


def frame(spark, ids, vectors, key, groups=None):
    rows = [(None if i is None else int(i), None if v is None else [float(x) for x in v], g) for i, v, g in zip(ids, vectors, groups or ["g"] * len(ids))]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<double>, grp string")


def brute(queries, ids, vectors, k):
    found = {}
    for at, question in enumerate(queries):
        away = np.add.accumulate((vectors - question) ** 2, axis=1)[:, -1]
        found[at] = [(int(ids[o]), round(away[o], 6)) for o in np.lexsort((ids, away))[:k]]
    return found


def ranked(hits):
    found = {}
    for row in hits.orderBy("query_id", "rank").collect():
        assert row["rank"] == len(found.setdefault(row["query_id"], [])) + 1
        found[row["query_id"]].append((row["page_id"], row["distance"]))
    return found


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 6)) * 20
    vectors = middles[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 6))
    vectors[500:1500] = vectors[7]  # a third are copies
    questions = np.vstack([vectors[rng.integers(0, 3000, 20)] + 0.1, vectors[7:8], rng.normal(size=(4, 6)) * 60])
    return rng.permutation(3000), vectors, questions


def test_equals_brute_force_and_leaves_most_pages_unread(spark, clustered, tmp_path, monkeypatch):
    ids, vectors, questions = clustered
    monkeypatch.setattr(cells, "BLOCKS_A_TASK", 8)
    monkeypatch.setattr(cells, "QUESTIONS", 3)  # hot blocks meet the questions in parts
    index = cells.build_cells(frame(spark, ids, vectors, "page_id").repartition(5), str(tmp_path / "index"), block_pages=40)
    sizes = index.blocks.collect()
    assert sum(b["n"] for b in sizes) == 3000 and max(b["n"] for b in sizes) <= 40
    assert len({b["block"] >> 24 for b in sizes}) > 3  # cells and copies lie in several tasks
    asked = frame(spark, range(len(questions)), questions, "query_id")
    found, expected = ranked(cells.cell_search(index, asked)), brute(questions, ids, vectors, 10)
    assert {q: [p for p, _ in hits] for q, hits in found.items()} == {q: [p for p, _ in hits] for q, hits in expected.items()}
    for q, hits in expected.items():
        assert [d for _, d in found[q]] == pytest.approx([d for _, d in hits], abs=2e-6)
    read = {r["query_id"]: r["pages_read"] for r in cells.share_read(index, asked).collect()}
    assert len(read) == len(questions) and max(read.values()) <= 3000 and np.median(list(read.values())) < 1200


def test_filtered_pages_only(spark, clustered, tmp_path):
    ids, vectors, questions = clustered
    groups = ["a" if i % 50 == 0 else None if i % 3 else "b" for i in ids]
    index = cells.build_cells(frame(spark, ids, vectors, "page_id", groups), str(tmp_path / "index"), block_pages=64)
    kept = np.array([g == "a" for g in groups])
    found = ranked(cells.cell_search(index, frame(spark, range(len(questions)), questions, "query_id"), where=F.col("grp") == "a"))
    expected = brute(questions, ids[kept], vectors[kept], 10)
    assert {q: [p for p, _ in hits] for q, hits in found.items()} == {q: [p for p, _ in hits] for q, hits in expected.items()}


def test_odd_rows_and_fewer_pages_than_wanted(spark, tmp_path):
    nan = float("nan")
    pages = frame(spark, [5, 3, 9, 9, 2, 1, None, 8], [[0, 1], [1, 0], [3, 4], [3, 4], [nan, 0], None, [0, 0], [1, 2, 3]], "page_id")
    pages = pages.withColumns({"cell": F.lit("x"), "block": F.lit(1)})  # clashing names
    index = cells.build_cells(pages, str(tmp_path / "index"))
    asked = frame(spark, [1, 2, 3, 4], [[0, 0], None, [nan, 1], [1, 2, 3]], "query_id")
    assert ranked(cells.cell_search(index, asked)) == {1: [(3, 1.0), (5, 1.0), (9, 25.0), (9, 25.0)]}
    assert cells.cell_search(index, asked.limit(0)).count() == 0


def test_empty_index(spark, tmp_path):
    index = cells.build_cells(frame(spark, [], [], "page_id"), str(tmp_path / "index"))
    assert cells.cell_search(index, frame(spark, [1], [[0, 0]], "query_id")).count() == 0
