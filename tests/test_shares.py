import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thematrail.operators import shares


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_missing_keys_count_in_the_global_denominator_only(mentions):
    df = mentions([("a", "g", "x", 6), ("a", "g", "y", 2), ("b", "g", None, 2), (None, None, "x", None)])
    rows = [tuple(r) for r in shares.category_share(df).collect()]
    assert rows == [("x", 6, 60.0), ("y", 2, 20.0)]
    assert as_dict(shares.sum_by(df, ["entity"]), "entity", "mentions") == {"a": 8, "b": 2}


def test_all_missing_group_sums_to_zero(mentions):
    df = mentions([("a", "g", "x", None), ("a", "g", "y", 4)])
    assert as_dict(shares.sum_by(df, ["category"]), "category", "mentions") == {"x": 0, "y": 4}


def test_total_of_nothing_is_zero(mentions):
    assert shares.total(mentions([]).filter("false")).collect()[0][0] == 0


def test_share_of_a_zero_group_is_missing(mentions):
    df = mentions([("a", "g", "x", 0), ("a", "g", "y", 0), ("a", "h", "x", 1)])
    found = {(r.grp, r.category): r.share for r in shares.group_category_share(df).collect()}
    assert found == {("g", "x"): None, ("g", "y"): None, ("h", "x"): 100.0}
    zero = shares.category_share(df.filter("grp = 'g'")).collect()
    assert [(r.category, r.share) for r in zero] == [("x", None), ("y", None)]


def test_top_contributors_label_from_zero_and_break_ties_by_name(mentions):
    df = mentions([(name, "g", "x", 5) for name in "kjihgfedcba"] + [("z", "g", "x", 9)])
    rows = shares.top_contributors(df).collect()
    assert [r.label for r in rows] == ["0 - z"] + [f"{i} - {name}" for i, name in enumerate("abcdefghi", 1)]


def test_row_share_matches_pandas(mentions):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), "g", rng.choice("xyz"), rng.choice([None, 0, 1, 5, 7])) for _ in range(300)]
    df = mentions(rows)
    found = as_dict(shares.entity_row_share(df), "row_id", "share")
    pdf = pd.DataFrame(rows, columns=["entity", "grp", "category", "mentions"])
    expected = pdf["mentions"] / pdf.groupby("entity")["mentions"].transform("sum") * 100
    assert len(found) == 300
    for i, value in expected.items():
        assert found[i] is None if pd.isna(value) else found[i] == pytest.approx(value)


def test_shares_sum_to_100(mentions):
    rng = random.Random(1)
    df = mentions([(str(rng.randrange(9)), str(rng.randrange(3)), str(rng.randrange(6)), rng.randrange(1, 9)) for _ in range(200)])
    assert shares.category_share(df).agg(F.sum("share")).collect()[0][0] == pytest.approx(100)
    for row in shares.group_category_share(df).groupBy("grp").agg(F.sum("share").alias("s")).collect():
        assert row.s == pytest.approx(100)


def test_top_contributors_keeps_only_the_top_rows_of_each_task(mentions, plan):
    assert "TakeOrderedAndProject" in plan(shares.top_contributors(mentions([("a", "g", "x", 1)])))


def test_category_share_reads_the_table_once(spark, tmp_path, mentions):
    path = str(tmp_path / "m")
    mentions([(str(i), "g", str(i % 5), i) for i in range(100)]).write.parquet(path)
    df = shares.category_share(spark.read.parquet(path))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_preview_takes_the_first_rows(mentions):
    df = mentions([(str(i), "g", "x", i) for i in range(30)]).orderBy(F.desc("row_id"))
    assert [r.row_id for r in shares.preview(df, 4).collect()] == [0, 1, 2, 3]
