import random
import re
from collections import Counter

import pytest

from thematrail.operators import extraction
from thematrail.operators.names import explode_names

DOCS = "doc_id bigint, entity string, grp string, text string"
LEXICON = {"climate": ["Climate", "climate change", "net-zero"], "debt": ["debt", "the debt"], "none": ["absent"]}


def docs_of(spark, texts):
    return spark.createDataFrame([(i, f"e{i}", "g", t) for i, t in enumerate(texts)], DOCS)


def brute_counts(text, lexicon):
    out = Counter()
    words = re.findall(r"[^\W_]+", text.lower())
    for category, terms in lexicon.items():
        for term in {" ".join(re.findall(r"[^\W_]+", t.lower())) for t in terms}:
            want = term.split()
            out[category] += sum(words[i:i + len(want)] == want for i in range(len(words)))
    return {c: n for c, n in out.items() if n}


TEXTS = [
    "Climate change! Climate. Changes; CLIMATE\nchange of climate change",
    "Debt. The debt of the indebted, net zero and net-zero.", "", "nothing here", "Le changement. climatechange",
]


def test_counts_whole_words_inside_sentences(spark):
    found = {}
    for r in extraction.count_mentions(docs_of(spark, TEXTS), LEXICON).collect():
        found.setdefault(r.doc_id, {})[r.category] = r.mentions
    assert found == {i: c for i, t in enumerate(TEXTS) if (c := brute_counts(t, LEXICON))}


def test_counts_match_brute_force_on_random_text(spark):
    rng = random.Random(8)
    vocabulary = ["climate", "change", "net", "zero", "debt", "the", "Été", "x1"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(60)) for _ in range(20)]
    found = {}
    for r in extraction.count_mentions(docs_of(spark, texts), LEXICON).collect():
        found.setdefault(r.doc_id, {})[r.category] = r.mentions
    assert found == {i: brute_counts(t, LEXICON) for i, t in enumerate(texts)}


def test_passages_rank_by_different_terms_then_position(spark):
    text = "No. Climate first. Debt and the debt. Climate and climate change. Climate last. Climate again"
    rows = extraction.example_passages(docs_of(spark, [text]), LEXICON, 3).orderBy("category", "place").collect()
    assert [(r.category, r.place, r.n_terms, r.passage) for r in rows] == [
        ("climate", 1, 2, "Climate and climate change."), ("climate", 2, 1, "Climate first."), ("climate", 3, 1, "Climate last."),
        ("debt", 1, 2, "Debt and the debt."),
    ]


@pytest.mark.parametrize("seed", range(2))
def test_importance_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xy"), rng.choice([1, 1, 2, 7]), rng.choice([100, 100, 1000, 333])) for i in range(90)]
    found = {r.doc_id: (r.rate, r.score) for r in extraction.importance(spark.createDataFrame(rows, "doc_id bigint, category string, mentions bigint, n_chars bigint")).collect()}
    for i, category, n, chars in rows:
        rates = [m * 100000.0 / c for _, k, m, c in rows if k == category]
        rate = n * 100000.0 / chars
        assert found[i] == (rate, 1 + 5 * sum(r < rate for r in rates) // len(rates))


def test_names_keep_documents_without_any(spark):
    docs = docs_of(spark, ["The World Bank and the imf", "The world banking", "IMF. World\nBank", "imf, WORLD BANK and imf"])
    lists = extraction.find_names(docs, ["World Bank", "IMF", "Bank"])
    found = {r.doc_id: r.names for r in lists.collect()}
    assert found == {0: "Bank, IMF, World Bank", 1: None, 2: "Bank, IMF, World Bank", 3: "Bank, IMF, World Bank"}
    assert explode_names(lists).count() == 9


def test_terms_cross_full_stops_and_line_ends(spark):
    docs = docs_of(spark, ["St. Mary Bank and the U.N. issue a green\nbond. FUND", "U. ... N! ? St"])
    found = extraction.find_names(docs, ["St. Mary Bank", "U.N.", "green bond", "fund", "FUND"])
    assert [r.names for r in found.orderBy("doc_id").collect()] == ["FUND, St. Mary Bank, U.N., fund, green bond", "U.N."]
    passages = extraction.example_passages(docs, {"x": ["Mary Bank", "the U.N."]}).filter("doc_id = 0").collect()
    assert [r.passage for r in passages] == ["Mary Bank and the U."]


def test_pages_hold_the_whole_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "é", "\n", " ", "\U0001f30d", "long line here"]) for _ in range(200)) for _ in range(5)]
    texts += ["x" * 95, "a\fb\n\fc", "", "line\n" * 30]
    pages = extraction.split_pages(docs_of(spark, texts), 20).orderBy("doc_id", "page_number").collect()
    for i, text in enumerate(texts):
        own = [p for p in pages if p.doc_id == i]
        assert "".join(p.text for p in own) == text.replace("\f", "")
        assert [p.page_number for p in own] == list(range(1, len(own) + 1))
        assert all(len(p.text) <= 21 for p in own)
    assert [p.text for p in pages if p.doc_id == 6] == ["a", "b\n", "c"]


def test_structured_results_and_compilation(spark):
    docs = docs_of(spark, TEXTS)
    one = extraction.structured_results(docs, LEXICON)
    rows = {(r.doc_id, r.category): (r.mention_count, r.examples) for r in one.collect()}
    assert rows[1, "debt"] == (3, "The debt of the indebted, net zero and net-zero.\nDebt.")
    both = extraction.compile_mentions(one, extraction.structured_results(docs, {"other": ["of"]}))
    assert both.count() == len(rows) + 2


def test_extraction_stays_in_the_jvm(spark, plan):
    docs = docs_of(spark, TEXTS)
    for df in (extraction.count_mentions(docs, LEXICON), extraction.example_passages(docs, LEXICON), extraction.split_pages(docs)):
        text = plan(df)
        assert "Python" not in text.replace("PythonRDD", "") and "CartesianProduct" not in text and "NestedLoop" not in text
