import pytest

from thematrail.operators.names import explode_names
from thematrail.plans import reports


def test_theme_report_after_filtering(mentions):
    df = mentions([("a", "g", "x", 6), ("a", "g", "y", 2), ("b", "h", "x", 2), ("b", "h", "z", 5)])
    tables = reports.theme_report(df, {"grp": ["g"], "entity": ["All"]})
    assert [tuple(r) for r in tables["category_share"].collect()] == [("x", 6, 75.0), ("y", 2, 25.0)]
    assert [tuple(r) for r in tables["edges"].collect()] == [("x", "y", 1, 100.0)]
    assert {r.category: r.degree for r in tables["nodes"].collect()} == {"x": 1, "y": 1}
    assert tables["stats"].collect()[0].n_rows == 2
    assert [r.value for r in tables["groups"].collect()] == ["All", "g", "h"]
    assert [r.label for r in tables["top_contributors"].collect()] == ["0 - a"]


def test_theme_report_of_nothing_and_of_one_category(mentions):
    df = mentions([("a", "g", "x", 6), ("b", "g", "x", 2)])
    for selections in ({"grp": []}, {}):
        tables = reports.theme_report(df, selections)
        assert tables["edges"].collect() == [] and tables["nodes"].collect() == []
    assert reports.theme_report(df, {"grp": []})["stats"].collect()[0].is_empty


def test_numeric_categories(spark):
    rows = [(0, "a", "g", 13, 4.0), (1, "a", "g", 5, 4.0), (2, "b", "g", 13, 2.0), (3, "b", "g", 5, None)]
    df = spark.createDataFrame(rows, "row_id bigint, entity string, grp string, category int, mentions double")
    tables = reports.theme_report(df, {"category": [5, 13]})
    assert [tuple(r) for r in tables["category_share"].collect()] == [(13, 6.0, 60.0), (5, 4.0, 40.0)]
    assert [tuple(r) for r in tables["edges"].collect()] == [(5, 13, 2, 100.0)]
    assert [r.value for r in tables["categories"].collect()] == ["All", "5", "13"]


def test_name_report(spark):
    rows = [(0, "a", "g", "AB, CD"), (1, "b", "g", "CD"), (2, "c", "h", "EF, AB"), (3, "d", "h", None)]
    lists = spark.createDataFrame(rows, "row_id bigint, entity string, grp string, names string")
    tables = reports.name_report(lists, explode_names(lists), ["All"], ["All"], ["AB", "EF"])
    assert [(r.label, r.n, r.share) for r in tables["name_share"].collect()] == [("0 - AB", 2, pytest.approx(200 / 3)), ("1 - EF", 1, pytest.approx(100 / 3))]
    assert {(r.name, r.grp): r.share for r in tables["name_group_share"].collect()} == {("AB", "g"): 100.0, ("AB", "h"): 50.0, ("EF", "h"): 50.0}
    assert tables["stats"].collect()[0].n_rows == 2
    assert [r.value for r in tables["names"].collect()] == ["All", "AB", "CD", "EF"]


def test_answer_prompts(spark):
    pages = spark.createDataFrame(
        [(i, 1, "e", "g", "l", f"page {i}", [float(i), 0.0]) for i in range(4)],
        "page_id bigint, page_number int, entity string, grp string, link string, text string, embedding array<float>",
    )
    turns = spark.createDataFrame([(7, 0, "user", "hello"), (7, 1, "assistant", "hi"), (7, 2, "user", "more")], "conv_id bigint, turn bigint, role string, text string")
    queries = spark.createDataFrame([(7, 0, [2.2, 0.0]), (7, 2, [0.1, 0.0])], "conv_id bigint, turn bigint, embedding array<float>")
    prompts = reports.answer_prompts(turns, queries, pages, pages, "Use:\n{context}\n", k=2).orderBy("turn").collect()
    assert [tuple(p) for p in prompts] == [
        (7, 0, "Use:\npage 2\n\npage 3\n\nuser: hello"),
        (7, 2, "Use:\npage 0\n\npage 1\n\nuser: hello\nassistant: hi\nuser: more"),
    ]
