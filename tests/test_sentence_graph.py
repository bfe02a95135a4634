import re

import numpy as np
import pyarrow as pa
import pytest

from thematrail.catalog import queries
from thematrail.operators import sentence_graph
from thematrail.operators.sentence_graph import MORE_WORDS, SCALE, SentenceGraph, graph_summaries

TEXTS = [
    ("a", 1, "The red fox runs. A blue whale sings! The red fox sleeps.\nThe red dog runs fast"),
    ("a", 2, "The red fox runs. Stones lie. A fox is red? 7 8 9."),
    ("a", 3, ""), ("a", 4, None), (None, 5, "No category here."), ("b", 6, "One only."), ("b", 7, " ... !\n"), ("c", 8, "x y. y z. z w. w x. y w."),
    ("a", 9, "The red fox and the blue whale meet. Stones sing."),
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(texts, "category string, row_id bigint, summary string")


def brute(texts, rounds):
    """Power iteration over the full matrix of the sentences, one category at a time."""
    scores = {}
    for category in {c for c, _, t in texts if c is not None and t is not None}:
        nodes = []
        for _, row, text in sorted(t for t in texts if t[0] == category and t[2] is not None):
            nodes += [(row, s.strip()) for s in re.findall(r"[^.!?\n]+[.!?]*", text) if s.strip() and s.strip() not in [n[1] for n in nodes]]
        words = [set(re.findall(r"[^\W_]+", s.lower())) for _, s in nodes]
        weight = {t: (len(nodes) // sum(t in w for w in words)).bit_length() - 1 for t in set().union(*words)}
        weight = {t: w for t, w in weight.items() if w}
        linked = [[sum(weight.get(t, 0) for t in a & b) for b in words] for a in words]
        x = [SCALE] * len(nodes)
        for _ in range(rounds):
            strongest = max((w * sum(x[i] for i, own in enumerate(words) if t in own) for t, w in weight.items()), default=0)
            x = [sum(map(int.__mul__, line, x)) // (len(own) + MORE_WORDS) // (strongest // SCALE + 1) for line, own in zip(linked, words)]
        scores |= {(category, row, s): v for (row, s), v in zip(nodes, x)}
    return scores


@pytest.mark.parametrize("max_terms", [2_000_000, 0])
def test_equals_iteration_over_the_full_matrix(spark, tmp_path, max_terms):
    graph = SentenceGraph(rows(spark), str(tmp_path / "graph"), max_terms)
    assert graph.sent == bool(max_terms)
    for rounds in (1, 4):
        found = {(r.category, r.row_id, r.sentence): r.score for r in graph.scores(rounds, None).collect()}
        assert found == brute(TEXTS, rounds)


def test_stops_at_the_tolerance_and_summarises(spark, tmp_path):
    graph = SentenceGraph(rows(spark), str(tmp_path / "graph"))
    settled = graph.scores(200, 0.001).drop("at").collect()
    written = len(list((tmp_path / "graph").glob("strengths-*")))
    assert written < 60
    exact = brute(TEXTS, 200)
    for category in "abc":  # shares of the strongest
        own = {r.sentence: r.score for r in settled if r.category == category}
        most, exact_most = max(own.values()) or 1, max(v for k, v in exact.items() if k[0] == category) or 1
        assert all(abs(own[s] / most - exact[c, i, s] / exact_most) < 0.02 for c, i, s in exact if c == category)
    found = {r.category: r.summary for r in graph_summaries(graph.scores(4, None), 2).collect()}
    ranked = sorted(((-v, row, s) for (c, row, s), v in brute(TEXTS, 4).items() if c == "a"))
    assert all(s in found["a"] for _, _, s in ranked[:2])
    assert found["b"] == "One only. ..."  # nothing links them: in their order


def test_empty_table_and_clashing_names(spark, tmp_path):
    table = rows(spark).limit(0)
    assert SentenceGraph(table, str(tmp_path / "none")).scores(3).count() == 0
    more = rows(spark).selectExpr("*", "1 AS at", "'x' AS term", "2 AS id")
    assert SentenceGraph(more, str(tmp_path / "more")).scores(2, None).count() == len(brute(TEXTS, 1))


@pytest.mark.parametrize("max_terms", [4, 0])
def test_only_words_between_those_sent_and_those_of_one_sentence_are_joined(spark, tmp_path, plan, max_terms):
    graph = SentenceGraph(rows(spark), str(tmp_path / "graph"), max_terms)
    joined, single, in_place = graph.links.selectExpr("sum(size(joined))", "sum(n_single)", "sum(size(ids))").first()
    assert joined and single > 10 and bool(in_place) == bool(max_terms)
    settled, sent = (g.scores(200, 0.02).count() for g in (graph, SentenceGraph(rows(spark), str(tmp_path / "sent"))))
    assert settled == sent
    assert len(list((tmp_path / "graph").glob("values-*"))) == len(list((tmp_path / "sent").glob("values-*"))) < 60
    found = graph.scores(4, None)
    assert {(r.category, r.row_id, r.sentence): r.score for r in found.collect()} == brute(TEXTS, 4)
    assert "hashpartitioning" not in plan(found)  # texts and values lie in the same buckets


def test_rows_of_one_key_are_sentences_of_their_own(spark, tmp_path):
    """Keys that repeat or are null, with words that are joined."""
    texts = [("a", None, "x y one."), ("a", 1, "x y two."), ("a", 1, "x z three."), ("a", 2, "w v. v z."), ("a", 2, "q q. r.")]
    found = [{(r.row_id, r.sentence): r.score for r in SentenceGraph(rows(spark, texts), str(tmp_path / str(n)), n).scores(3, None).collect()} for n in (0, 100)]
    assert found[0] == found[1] and len(found[0]) == 7 and found[0][None, "x y one."] > 0


def test_sums_beyond_64_bits_are_exact():
    weighted = [2**62 + 12345, 2**62 + 1, 2**61 + 7, 5]
    ids = [[0, 1, 2, 0], [], [3, 2]]
    batch = pa.RecordBatch.from_pydict({
        "code": pa.array([0, 0, 0], pa.int32()), "n_terms": pa.array([5, 3, 2], pa.int32()), "n_single": pa.array([1, 2, 0], pa.int32()),
        "ids": pa.array(ids, pa.list_(pa.int32())), "x": pa.array([9, 11, 0], pa.int64()), "high": pa.array([3, 0, 0], pa.int64()), "low": pa.array([4, 0, 0], pa.int64()),
    })
    found = sentence_graph._values(batch, np.array(weighted), np.array([10**13]), np.array([6]))
    told, own = [3 * 2**31 + 4, 0, 0], [6 * 9, 6 * 2 * 11, 0]
    sums = [sum(weighted[i] for i in ids[r]) + told[r] + own[r] for r in range(3)]
    assert sums[0] > 2**63 and found.tolist() == [s // (n + MORE_WORDS) // 10**13 for s, n in zip(sums, [5, 3, 2])]


def settled(texts, tolerance):
    """Scores by ``brute`` after as many rounds as each category takes until no word's share of its strongest moves by more than ``tolerance``, and these rounds."""
    found, taken = {}, {}
    for category in {c for c, _, _ in brute(texts, 0)}:
        rounds, before = 0, None
        while True:
            own = {s: v for (c, _, s), v in brute(texts, rounds).items() if c == category}
            words = {s: set(re.findall(r"[^\W_]+", s.lower())) for s in own}
            sums = {t: sum(v for s, v in own.items() if t in words[s]) for t in set().union(*words.values()) if 2 * sum(t in w for w in words.values()) <= len(own)}
            most = max(sums.values(), default=0)
            now = {t: y / most for t, y in sums.items()} if most else {}
            if before is not None and (most <= 1 / tolerance or max(abs(now[t] - before[t]) for t in now) <= tolerance):
                break
            rounds, before = rounds + 1, now
        taken[category] = rounds + 1
        found |= {k: v for k, v in brute(texts, rounds + 1).items() if k[0] == category}
    return found, taken


def test_registered_queries_go_on_until_the_ranking_has_settled(spark, tmp_path):
    docs = [(i, t, "en", c, 0) for c, i, t in TEXTS]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    exact, rounds = settled(TEXTS, sentence_graph.TOLERANCE)
    assert rounds["a"] > 8 and len(set(rounds.values())) > 1 and all(any(v for k, v in exact.items() if k[0] == c) for c in "ac")
    found = queries()["sentence_ranks"](spark, str(tmp_path)).collect()
    assert {(r.category, r.row_id, r.sentence): r.score for r in found} == exact
    summaries = {r.category: r.summary for r in queries()["graph_summaries"](spark, str(tmp_path)).collect()}
    for category in "abc":
        own = [(s, v) for (c, _, s), v in exact.items() if c == category]  # in reading order
        chosen = sorted(own, key=lambda one: -one[1])[:3]
        assert summaries[category] == " ".join(s for s, _ in own if s in dict(chosen))


@pytest.mark.parametrize("max_terms", [2_000_000, 0])
def test_rounds_write_over_those_that_are_not_read_any_more(spark, tmp_path, max_terms):
    graph = SentenceGraph(rows(spark), str(tmp_path / "graph"), max_terms)
    found = {(r.category, r.row_id, r.sentence): r.score for r in graph.scores(9, None).collect()}
    assert found == brute(TEXTS, 9)
    assert len(list((tmp_path / "graph").glob("values-*"))) == 3
    assert len(list((tmp_path / "graph").glob("strengths-*"))) == (0 if max_terms else 2)
    with pytest.raises(ValueError):
        graph.scores(None, None)


def test_whole_numbers_that_come_again_end_the_rounds(spark, tmp_path, monkeypatch):
    texts = [("a", 1, "x one. x two. y three. y four.")]
    graph = SentenceGraph(rows(spark, texts), str(tmp_path / "graph"))
    monkeypatch.setattr(SentenceGraph, "_moved", lambda self, *_: np.ones(1, bool))
    assert {r.score for r in graph.scores().collect()} == {0}  # linked too weakly, values fall to zero and stay there
    monkeypatch.undo()
    assert {r.score for r in graph.scores().collect()} == set(settled(texts, 0.001)[0].values()) != {0}
