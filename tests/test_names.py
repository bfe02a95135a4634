import pandas as pd
import pytest

from thematrail.operators import names


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i, name in enumerate("abcdefghijkl"):
        rows += [(name, "g" if j % 2 else "h") for j in range(3 + (i // 2))]
    rows += [(None, "g"), ("a", None)]
    return rows, spark.createDataFrame([(i, "e", g, n) for i, (n, g) in enumerate(rows)], "row_id bigint, entity string, grp string, name string")


def test_share_is_over_all_names(table):
    rows, df = table
    found = names.name_share(df).collect()
    counts = pd.Series([n for n, _ in rows if n is not None]).value_counts()
    assert len(found) == 10
    for i, row in enumerate(found):
        assert row.label == f"{i} - {row.name}" and row.n == counts[row.name]
        assert row.share == pytest.approx(100 * counts[row.name] / counts.sum())
    assert [r.name for r in found[:4]] == ["k", "l", "i", "j"]


def test_group_share_is_over_the_top_names_only(table):
    rows, df = table
    pdf = pd.DataFrame(rows, columns=["name", "grp"]).dropna().groupby(["name", "grp"]).size().reset_index(name="n")
    top = pdf.groupby("name")["n"].sum().nlargest(10).index
    kept = pdf[pdf["name"].isin(top)].copy()
    kept["share"] = kept.groupby("grp")["n"].transform(lambda x: x / x.sum() * 100)
    found = {(r.name, r.grp): (r.n, r.share) for r in names.name_group_share(df).collect()}
    assert found.keys() == set(zip(kept["name"], kept["grp"]))
    for row in kept.itertuples():
        assert found[row.name, row.grp] == (row.n, pytest.approx(row.share))
