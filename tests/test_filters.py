import pytest

from thematrail.operators import filters
from thematrail.operators.names import explode_names
from thematrail.operators.shares import top_keys

ROWS = [("a", "g", "x", 1), ("b", "g", "y", 2), ("c", "h", "x", 3), (None, "h", None, 4)]


@pytest.mark.parametrize("selections, kept", [
    ({}, {0, 1, 2, 3}),
    ({"grp": ["All"]}, {0, 1, 2, 3}),
    ({"grp": ["All", "g"], "category": ["x"]}, {0, 2}),
    ({"grp": ["g"], "category": ["x"]}, {0}),
    ({"grp": ["nowhere"]}, set()),
    ({"entity": []}, set()),
])
def test_members(mentions, selections, kept):
    assert {r.row_id for r in filters.filter_members(mentions(ROWS), selections).collect()} == kept


@pytest.mark.parametrize("entities, groups, kept", [
    (["All"], ["All"], {0, 1, 2, 3}),
    ([], [], {0, 1, 2, 3}),
    (["a"], ["All"], {0}),
    (["a"], [], {0}),
    (["a"], ["h"], {2, 3}),
    (["All"], ["h"], {2, 3}),
    (["a"], ["All", "h"], {0}),
])
def test_metadata_filter_lets_groups_replace_entities(mentions, entities, groups, kept):
    where = filters.metadata_filter(entities, groups)
    df = mentions(ROWS)
    assert {r.row_id for r in (df if where is None else df.filter(where)).collect()} == kept


@pytest.fixture(scope="module")
def lists(spark):
    rows = [
        (0, "a", "g", "AB, \tCD\n,EF"), (1, "b", "g", None), (2, "c", "h", "AB CD"),
        (3, "d", "h", "CD,, "), (4, "e", "h", ""), (5, "f", "h", " AB "),
    ]
    return spark.createDataFrame(rows, "row_id bigint, entity string, grp string, names string")


@pytest.mark.parametrize("chosen, kept", [
    (["AB"], {0, 5}), (["CD", "nowhere"], {0, 3}), (["AB CD"], {2}), (["All", "AB"], {0, 1, 2, 3, 4, 5}), ([], set()),
])
def test_name_list(lists, chosen, kept):
    assert {r.row_id for r in filters.filter_name_list(lists, "names", chosen).collect()} == kept


def test_name_list_selects_what_the_exploded_names_select(lists):
    for chosen in (["AB"], ["CD"], ["EF", "AB CD"]):
        exploded = filters.filter_members(explode_names(lists), {"name": chosen})
        assert {r.row_id for r in exploded.collect()} == {r.row_id for r in filters.filter_name_list(lists, "names", chosen).collect()}


def test_explode_drops_empty_items_and_missing_lists(lists):
    rows = sorted((r.row_id, r.name) for r in explode_names(lists).collect())
    assert rows == [(0, "AB"), (0, "CD"), (0, "EF"), (2, "AB CD"), (3, "CD"), (5, "AB")]


def test_domain_lists_all_first_and_numbers_by_value(spark):
    df = spark.createDataFrame([(10,), (2,), (None,), (2,)], "category int")
    assert [(r.ord, r.value) for r in filters.domain_values(df, "category").collect()] == [(0, "All"), (1, "2"), (1, "10")]


def test_stats(mentions):
    df = mentions(ROWS)
    assert tuple(filters.filter_stats(df).collect()[0]) == (4, False)
    assert tuple(filters.filter_stats(filters.filter_members(df, {"grp": []})).collect()[0]) == (0, True)


@pytest.mark.parametrize("categories, kept", [(["x"], 0), (["x", "x"], 0), (["x", "y"], 2), (["x", None], 2)])
def test_gate_counts_a_missing_value(mentions, categories, kept):
    df = mentions([("a", "g", c, 1) for c in categories])
    assert filters.gate_min_distinct(df, "category").count() == kept


def test_keep_keys_is_a_broadcast_semi_join(mentions, plan):
    df = mentions(ROWS)
    kept = filters.keep_keys(df, top_keys(df, "category", "mentions", 1), "category")
    assert {r.row_id for r in kept.collect()} == {0, 2}
    assert "LeftSemi" in plan(kept) and "BroadcastHashJoin" in plan(kept)


def test_filters_reach_the_parquet_scan(spark, tmp_path, mentions, plan):
    path = str(tmp_path / "m")
    mentions(ROWS).write.parquet(path)
    kept = filters.filter_members(spark.read.parquet(path), {"grp": ["g"]}).select("row_id")
    text = plan(kept)
    assert "PushedFilters: [In(grp, [g])]" in text or "EqualTo(grp,g)" in text
    assert "ReadSchema: struct<row_id:bigint,grp:string>" in text
