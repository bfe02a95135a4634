import random
import re

import pytest

from test_extraction import DOCS, LEXICON, TEXTS, brute_counts, docs_of
from thematrail.operators import extraction, lexicon


def mentions(found):
    out = {}
    for r in lexicon.mentions_found(found).collect():
        out.setdefault(r.doc_id, {})[r.category] = r.mentions
    return out


@pytest.fixture(params=[lexicon.AUTOMATON_BYTES, 0], ids=["automaton", "joined"])
def limit(request):
    return request.param


def test_counts_match_brute_force(spark, limit):
    rng = random.Random(8)
    vocabulary = ["climate", "change", "net", "zero", "debt", "the", "Été", "x1"]
    texts = TEXTS + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(60)) for _ in range(20)]
    terms = LEXICON | {"both": ["debt", "zero net", "the", "change climate change"], "overlap": ["net zero net", "zero net", "net"], "none": [" - ", ""]}
    found = lexicon.term_hits(docs_of(spark, texts), lexicon.lexicon_table(spark, terms), automaton_bytes=limit)
    assert mentions(found) == {i: c for i, t in enumerate(texts) if (c := brute_counts(t, {k: [x for x in v if x.strip(" -")] for k, v in terms.items()}))}


def test_passages_equal_those_of_the_expressions(spark, limit):
    text = "No. Climate first. Debt and the debt. Climate and climate change. Climate last. Climate again. The\ndebt"
    docs = docs_of(spark, [text, *TEXTS])
    rows = lexicon.passages_found(lexicon.term_hits(docs, lexicon.lexicon_table(spark, LEXICON), automaton_bytes=limit))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, extraction.example_passages(docs, LEXICON).collect()))


def test_names_keep_documents_without_any(spark, limit):
    docs = docs_of(spark, ["The World Bank and the imf", "The world banking", "IMF. World\nBank", ""])
    names = spark.createDataFrame([("World Bank",), ("IMF",), ("Bank",), (None,), ("Bank",)], "name string")
    found = lexicon.names_found(lexicon.term_hits(docs, lexicon.name_table(names), automaton_bytes=limit))
    assert {r.doc_id: r.names for r in found.collect()} == {0: "Bank, IMF, World Bank", 1: None, 2: "Bank, IMF, World Bank", 3: None}


def test_empty_lexicons_nulls_and_repeated_rows(spark, limit):
    rows = [(1, "e", "g", None), (2, "e", "g", "debt debt"), (2, "e", "g", "debt debt"), (None, None, None, "Debt")]
    docs = spark.createDataFrame(rows, DOCS)
    terms = lexicon.lexicon_table(spark, {"d": ["debt"]})
    found = lexicon.mentions_found(lexicon.term_hits(docs, terms, automaton_bytes=limit)).collect()
    assert sorted((r.doc_id or 0, r.mentions) for r in found) == [(0, 1), (2, 2), (2, 2)]
    empty = lexicon.term_hits(docs, terms.limit(0), automaton_bytes=limit)
    assert empty.count() == 4 and lexicon.mentions_found(empty).count() == 0
    assert lexicon.term_hits(docs.limit(0), terms, automaton_bytes=limit).count() == 0


def test_the_automaton_finds_overlapping_terms():
    automaton = lexicon.TermAutomaton([("a", "b", "a"), ("b", "a"), ("a",), ("b", "a", "b", "c"), ("q",)])
    text = "a b a b c x b a".split()
    brute = {(i, k) for k, t in enumerate([("a", "b", "a"), ("b", "a"), ("a",), ("b", "a", "b", "c"), ("q",)]) for i in range(len(text)) if tuple(text[i : i + len(t)]) == t}
    assert set(automaton.walk(text)) == brute


def test_programmed_lexicons_may_be_empty(spark):
    docs = docs_of(spark, TEXTS)
    for empty in ({}, {"t": []}, {"t": ["..."]}):
        assert extraction.count_mentions(docs, empty).count() == 0
        assert extraction.example_passages(docs, empty).count() == 0
        assert extraction.structured_results(docs, empty).count() == 0
    assert {r.names for r in extraction.find_names(docs, []).collect()} == {None}


def test_many_equal_rates_are_ranked_as_one_row(spark):
    rows = [(i, "x", 2, 100) for i in range(500)] + [(500 + i, "x", i, 100) for i in range(1, 9)] + [(600, None, 1, 100), (601, "y", 0, 10)]
    scores = {r.doc_id: r.score for r in extraction.importance(spark.createDataFrame(rows, "doc_id bigint, category string, mentions bigint, n_chars bigint")).collect()}
    rates = [m for _, c, m, _ in rows if c == "x"]
    assert all(scores[i] == 1 + 5 * sum(r < m for r in rates) // len(rates) for i, c, m, _ in rows if c == "x") and scores[601] == 1 and 600 not in scores


def test_only_runs_that_may_be_terms_are_moved(spark, plan, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_BITS", 15)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" + rng.choice(["", "", ".", "\n"]) for _ in range(400)) for _ in range(12)]
    terms = {f"c{j}": [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(900)] for j in range(3)}
    found = lexicon.term_hits(docs_of(spark, texts), lexicon.lexicon_table(spark, terms), automaton_bytes=0)
    walked = lexicon.term_hits(docs_of(spark, texts), lexicon.lexicon_table(spark, terms))
    assert sorted(map(str, found.collect())) == sorted(map(str, walked.collect()))
    assert "Generate" not in plan(found)  # no row a word


@pytest.mark.parametrize("part_bytes", [6_000, 1 << 27])
def test_larger_lexicons_move_no_text_and_no_occurrence(spark, plan, monkeypatch, part_bytes):
    monkeypatch.setattr(lexicon, "PART_BYTES", part_bytes, raising=False)
    monkeypatch.setattr(lexicon, "HELD_WORDS", 150, raising=False)
    rng = random.Random(5)
    word = lambda: rng.choice(["é", "ß", "", "ab"]) + f"w{rng.randrange(40)}"
    texts = [" ".join(word() + rng.choice(["", "", ". ", "\n", " !"]) for _ in range(rng.choice([0, 3, 200]))) for _ in range(40)] + [None]
    terms = {f"c{j}": [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 5]))) for _ in range(60)] for j in range(4)}
    terms["é"] = terms["c0"][:9]  # terms of two categories
    terms["z"] = [" ".join(re.findall(r"[^\W_]+", texts[3] or "a b"))]  # a whole text
    found = lexicon.term_hits(docs_of(spark, texts), lexicon.lexicon_table(spark, terms), automaton_bytes=0)
    walked = lexicon.term_hits(docs_of(spark, texts), lexicon.lexicon_table(spark, terms))
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, walked.collect())) and sum("mentions=" in r for r in rows) > 10
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
