import pytest
from pyspark.sql import functions as F

from thematrail.operators import filters, shares
from thematrail.operators.cube import ShareCube

SCHEMA = "entity string, grp string, category string, mentions bigint, n int, level string"
ROWS = [("e%d" % (i % 7) if i % 11 else None, "g%d" % (i % 3) if i % 13 else None, "c%d" % (i % 5) if i % 5 else None, i % 9 if i % 4 else None, 1, "x") for i in range(300)]
ROWS += [("hot", "g1", "c1", 2, 1, "x")] * 150  # a third of the rows
SELECTIONS = [{}, {"grp": ["g1", "g2"]}, {"entity": ["e1"], "category": ["c1", "c2", "All"]}, {"category": ["c3"], "grp": ["g0"]}, {"grp": []}, {"entity": ["none"]}]


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_answers_equal_the_direct_ones_after_two_loads(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    cube = ShareCube(spark, str(tmp_path / "cube"))
    cube.load(table.filter("mentions > 3"), "first")
    cube.load(spark.createDataFrame([("wrong", "g1", "c1", 5, 1, "x")], SCHEMA), "second")
    cube.load(table.filter("mentions <= 3 OR mentions IS NULL"), "second")  # repeated: replaces
    small = cube.compacted(str(tmp_path / "small"))
    for held in (cube, small):
        for chosen in SELECTIONS:
            direct = filters.filter_members(table, chosen)
            assert same(shares.category_share(held.cells(["category"], chosen)), shares.category_share(direct))
            assert same(shares.total(held.cells((), chosen)), shares.total(direct))
            assert same(held.filter_stats(chosen), filters.filter_stats(direct))
        chosen = SELECTIONS[1]
        direct = filters.filter_members(table, chosen)
        assert same(shares.group_category_share(held.cells(["grp", "category"], chosen)), shares.group_category_share(direct))
        assert same(shares.top_contributors(held.cells(["entity"], chosen), 3), shares.top_contributors(direct, 3))
        assert same(filters.domain_values(held.cells(["entity"]), "entity"), filters.domain_values(table, "entity"))


def test_a_report_reads_its_level_only(spark, tmp_path, plan):
    cube = ShareCube(spark, str(tmp_path / "cube"))
    cube.load(spark.createDataFrame(ROWS, SCHEMA), "all")
    assert cube.cells(["category"]).count() == 5 and cube.cells().count() == 1
    assert cube.cells(["category"], {"grp": ["All"]}).columns == ["category", "mentions", "n"]
    text = plan(cube.cells(["category"]))
    assert "PartitionFilters: [isnotnull(level" in text and "ReadSchema: struct<category:string,mentions:bigint,n:bigint>" in text
    with pytest.raises(ValueError):
        cube.cells(["row_id"])
    with pytest.raises(ValueError):
        cube.load(spark.createDataFrame(ROWS, SCHEMA), "../up")


def test_empty_loads(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    cube = ShareCube(spark, str(tmp_path / "cube"))
    cube.load(empty, "none")
    cube.load(spark.createDataFrame([(None, None, None, None, 1, "x")], SCHEMA), "nulls")
    assert shares.category_share(cube.cells(["category"])).count() == 0
    assert cube.filter_stats().first() == (1, False) and shares.total(cube.cells()).first()[0] == 0
    assert cube.cells(["category"]).select(F.col("category")).first()[0] is None
