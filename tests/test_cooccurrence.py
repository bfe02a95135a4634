import random
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest

from thematrail.operators import cooccurrence as co
from thematrail.operators.filters import gate_min_distinct


def brute(rows, k_entity=5, k_global=5):
    """The same result from pandas, rows put in (category, row_id) order so that the first of equals wins."""
    df = pd.DataFrame(rows, columns=["entity", "grp", "category", "mentions"]).reset_index(names="row_id")
    df = df.sort_values(["category", "row_id"], na_position="first")
    df["share"] = df["mentions"] / df.groupby("entity")["mentions"].transform("sum") * 100
    top = [part.nlargest(k_entity, "share") for _, part in df.groupby("entity")]
    top = pd.concat(top)
    sums = top.groupby("category")["mentions"].sum().reset_index()
    keys = sums.assign(share=sums["mentions"] / top["mentions"].sum() * 100).nlargest(k_global, "share")["category"].tolist()
    pairs = Counter()
    for _, part in top[top["category"].isin(keys)].groupby("entity"):
        pairs.update(combinations(sorted(set(part["category"])), 2))
    return set(map(tuple, top[["entity", "row_id"]].itertuples(index=False))), keys, dict(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_matches_pandas_on_ties_nulls_and_repeats(mentions, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "b", "c", "d", "e", None]), "g", rng.choice(["p", "q", "r", "s", "t", "u", "v"]), rng.choice([None, 0, 0, 1, 1, 2, 3]))
        for _ in range(120)
    ]
    rows += [("zero", "g", c, n) for c, n in [("q", None), ("p", 0), ("r", 0), ("q", 0), ("p", None), ("s", 0), ("t", None)]]
    rows += [("blank", "g", c, None) for c in "vutsrqp"]
    top, keys, pairs = brute(rows)
    df = mentions(rows)
    assert {(r.entity, r.row_id) for r in co.top_rows_per_entity(df).collect()} == top
    assert [r.category for r in co.global_top_categories(df).orderBy("mentions", ascending=False).collect()][:1] == keys[:1]
    assert {r.category for r in co.global_top_categories(df).collect()} == set(keys)
    edges = co.cooccurrence(df).collect()
    assert {(r.a, r.b): r.n for r in edges} == pairs
    assert sum(r.weight for r in edges) == pytest.approx(100)


def test_rows_not_categories_fill_the_places(mentions):
    df = mentions([("a", "g", "x", n) for n in (9, 8, 7, 6, 5)] + [("a", "g", "y", 1)])
    assert {r.category for r in co.top_rows_per_entity(df).collect()} == {"x"}


def test_no_pair_gives_no_edges(mentions):
    df = mentions([("a", "g", "x", 1), ("b", "g", "y", 1), ("c", "g", "z", 1)])
    assert co.cooccurrence(df).collect() == []
    one = mentions([("a", "g", "x", 1), ("b", "g", "x", 1)])
    assert gate_min_distinct(co.cooccurrence(one), "category", source=one).collect() == []


def test_isolated_node_has_degree_zero(mentions):
    df = mentions([("a", "g", "x", 5), ("a", "g", "y", 5), ("b", "g", "z", 9)])
    edges = co.cooccurrence(df)
    nodes = co.graph_nodes(co.global_top_categories(df), edges)
    found = {r.category: (r.degree, r.marker_size) for r in co.graph_degree(nodes, edges).collect()}
    assert found == {"x": (1, 5), "y": (1, 5), "z": (0, 0)}


def test_degrees_sum_to_twice_the_edges(mentions):
    rng = random.Random(9)
    df = mentions([(str(rng.randrange(6)), "g", rng.choice("pqrst"), rng.randrange(1, 5)) for _ in range(80)])
    edges = co.cooccurrence(df)
    degrees = co.graph_degree(co.graph_nodes(co.global_top_categories(df), edges), edges).collect()
    assert sum(r.degree for r in degrees) == 2 * edges.count()


def test_entity_cut_comes_before_the_shuffle(mentions, plan):
    text = plan(co.top_rows_per_entity(mentions([("a", "g", "x", 1)])))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_shuffle_serves_pairs_and_leading_categories(spark, tmp_path, mentions):
    path = str(tmp_path / "m")
    mentions([(str(i % 7), "g", str(i % 5), i) for i in range(200)]).write.parquet(path)
    df = co.cooccurrence(spark.read.parquet(path))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert len([line for line in final.split("== Initial Plan ==")[0].splitlines() if "FileScan" in line]) == 2
