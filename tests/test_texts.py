from collections import Counter
import random
import re

import pytest
from pyspark.sql import functions as F

from thematrail.operators import summaries, texts
from thematrail.plans.reports import role_summary, summary_report


def test_missing_summaries_leave_no_label_shift(mentions):
    df = mentions([("a", "g", "x", 1, "one"), ("a", "g", "y", 1, None), ("b", "g", "z", 1, "three"), ("b", "g", "x", 1, "two"), ("b", "g", None, 1, "no")])
    found = {r.category: r.text for r in texts.text_by_category(df).collect()}
    assert found == {"x": "one two", "z": "three"}
    keyed = texts.attach_by_key(df.select("category").distinct(), texts.text_by_category(df).select("category", F.col("text").alias("summary")))
    assert {r.entry for r in keyed.collect()} == {"**x** : one two", "**z** : three"}


def test_top_k_keeps_the_largest_categories(mentions):
    df = mentions([("a", "g", c, n, c) for c, n in zip("abcdefg", (1, 5, 5, 9, 5, 5, 0))])
    assert {r.category for r in texts.text_by_category(df, top_k=3).collect()} == {"d", "b", "c"}


def test_chunks_in_order_are_the_whole_text(mentions):
    rng = random.Random(4)
    rows = [("a", "g", rng.choice("xxxy"), 1, f"s{i}") for i in range(100)]
    chunks = texts.text_by_category(mentions(rows), rows_per_chunk=7).orderBy("category", "chunk").collect()
    assert max(r.n_rows for r in chunks) <= 7
    for category in "xy":
        whole = " ".join(r.text for r in chunks if r.category == category)
        assert whole == " ".join(s for _, _, c, _, s in rows if c == category)


@pytest.mark.parametrize("chunk_chars, block_rows", [(1, 2), (7, 3), (40, 10), (10_000, 10_000)])
def test_chunks_are_cut_by_characters_whatever_the_texts(spark, chunk_chars, block_rows):
    rng = random.Random(chunk_chars)
    words = ["", "a", "é€", "\U0001f600", "long text " * 12, None]
    rows = [(rng.choice(["x", "x", "x", "y", None]), i, rng.choice(words), "c", 1) for i in rng.sample(range(300), 60)] + [("empty", 5, "", "c", 1), ("x", None, "lost", "c", 1)]
    df = spark.createDataFrame(rows, "category string, row_id bigint, text string, chunk string, size int")
    got = texts.text_chunks(df, "; ", ["category"], chunk_chars, block_rows).collect()
    for category in {r[0] for r in rows}:
        whole = "; ".join(t for c, i, t, _, _ in sorted(rows, key=lambda r: (r[1] is None, r[1])) if c == category and t is not None and i is not None)
        found = {r.chunk: r.text for r in got if r.category == category}
        assert found == {k: whole[k * chunk_chars : (k + 1) * chunk_chars] for k in range(-(-len(whole) // chunk_chars))}
    assert all(r.n_chars == len(r.text) <= chunk_chars for r in got)
    assert [r.text for r in texts.text_chunks(df.filter("row_id IS NULL OR category = 'empty'"), "; ", [], chunk_chars).collect()] == []
    assert texts.text_chunks(df.limit(0), "; ", ["category"]).count() == 0


def test_role_paragraphs(spark):
    df = spark.createDataFrame([(0, "A", "r1"), (1, None, None)], "row_id bigint, entity string, role_summary string")
    lead = "Rôle des Banques Publiques de Développement dans le fichier "
    expected = f"{lead}A :\nr1\n\n" + "\n" + f"{lead}nan :\nnan\n\n"
    assert [r.text for r in texts.entity_context(df).collect()] == [expected]
    assert "r1" in role_summary(df).collect()[0].summary or "Rôle" in role_summary(df).collect()[0].summary


def brute_summary(rows, n, one_in=20):
    def words(s):
        return re.findall(r"[^\W_]+", s.lower())

    def split(s):
        return [p for p in (m.strip() for m in re.findall(r"[^.!?\n]+[.!?]*", s)) if p]

    out = {}
    for category in {c for c, _, _ in rows}:
        own = [(i, s) for c, i, s in rows if c == category]
        counts = Counter(w for _, s in own for w in set(words(s)))
        terms = {w for w, found in counts.items() if found * one_in >= len(own)}
        best = {}
        for i, s in own:
            for at, p in enumerate(split(s)):
                key = (-len(set(words(p)) & terms), i, at)
                best[p] = min(best.get(p, key), key)
        if terms:
            chosen = sorted(best.items(), key=lambda e: e[1])[:n]
            out[category] = " ".join(p for p, _ in sorted(chosen, key=lambda e: e[1][1:]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_map_summary_matches_brute_force(mentions, seed):
    rng = random.Random(seed)
    vocabulary = ["finance", "climate", "public", "banks", "support", "of", "the", "trade", "health"]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 7))) + rng.choice([". ", "! ", "\n", ".\n"])
    rows = [("e", "g", rng.choice("xyz"), 1, "".join(sentence() for _ in range(rng.randrange(1, 6)))) for _ in range(25)]
    rows += rows[:8]  # copies
    found = {r.category: r.summary for r in summaries.summarize_map(mentions(rows), 3, 2).collect()}
    assert found == brute_summary([(c, i, s) for i, (_, _, c, _, s) in enumerate(rows)], 3, 2)
    whole = summaries.summarize_reduce(summaries.summarize_map(mentions(rows), 3, 2), 2, one_in=2).collect()[0].summary
    assert whole == brute_summary([("", c, s) for c, s in found.items()], 2, 2)[""]


def test_a_category_without_key_terms_keeps_its_summary(mentions):
    rows = [("e", "g", "a", 1, "an ox is in it. so be it"), ("e", "g", "b", 1, "Public banks finance climate")]
    assert {r.category: r.summary for r in summaries.summarize_map(mentions(rows)).collect()}["a"] == "an ox is in it. so be it"


def test_summary_report(mentions):
    df = mentions([("e", "g", "x", 1, "Public banks finance climate action. Short."), ("e", "g", "y", 2, "Trade supports growth."), ("e", "g", "z", 0, None)])
    report = summary_report(df)
    assert {r.category for r in report["per_category"].collect()} == {"x", "y"}
    assert report["whole"].count() == 1


def test_only_the_best_sentences_are_shuffled(mentions, plan):
    text = plan(summaries.summarize_map(mentions([("e", "g", "x", 1, "some words here")])))
    assert "WindowGroupLimit" in text and "Python" not in text


def test_texts_stay_where_they_are_while_key_terms_are_few(mentions, plan, monkeypatch):
    df = mentions([("e", "g", c, 1, f"some words here {c}") for c in "xyxyz"])
    assert "BroadcastHashJoin" in plan(summaries.summarize_map(df))
    monkeypatch.setattr(summaries, "TERM_BYTES", 0)
    moved = summaries.summarize_map(df)
    assert {r.category for r in moved.collect()} == {"x", "y", "z"}
