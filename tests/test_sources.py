from thematrail import sources
from thematrail.sources.delimited import NUMBERED_THEMES, whole_numbers

CSV = '''Groupe,Entity,ODD number,ODD count,Summary,Extra
g,A,1,2,"line one
line ""two"", end",x
NA,B,None,3.0,,y
"h, i",C,4,many," kept blanks ",z
nan,D,5.7,,None,
'''
SCHEMA = "Groupe string, Entity string, `ODD number` int, `ODD count` bigint, Summary string"


def test_csv_quirks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    df = sources.canonical(sources.load_csv(spark, str(path), SCHEMA), NUMBERED_THEMES)
    assert df.columns == ["grp", "entity", "category", "mentions", "summary"]
    assert [tuple(r) for r in df.collect()] == [
        ("g", "A", 1, 2, 'line one\nline "two", end'),
        (None, "B", None, 3, None),
        ("h, i", "C", 4, None, " kept blanks "),
        (None, "D", 5, None, None),
    ]


def test_whole_numbers_cut_off_fractions(spark):
    df = spark.createDataFrame([(2.9, 1.0), (float("nan"), None)], "a double, b double")
    assert [tuple(r) for r in whole_numbers(df, "a", "b").collect()] == [(2, 1), (None, None)]


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a,"b"\nc '), (2, "")], "n bigint, s string")
    sources.write_report(df, str(tmp_path / "c"), "csv")
    sources.write_report(df, str(tmp_path / "p"))
    back = sources.load_csv(spark, str(tmp_path / "c"), "n bigint, s string")
    assert sorted(map(tuple, back.collect())) == [(1, ' a,"b"\nc '), (2, None)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, ' a,"b"\nc '), (2, "")]


def test_pages_and_cache(spark, tmp_path):
    rows = [(1, 2, "e", "g", None, "t", [0.5, 1.0])]
    spark.createDataFrame(rows, sources.stored.PAGE_SCHEMA).write.parquet(str(tmp_path / "p"))
    pages = sources.cached(sources.load_pages(spark, str(tmp_path / "p")))
    assert [tuple(r) for r in pages.collect()] == rows and pages.is_cached
    pages.unpersist()
