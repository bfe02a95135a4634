import duckdb
import pytest

import check_oracle
import corpus_pipeline
from thematrail.llm import queries

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"op2_text_density", "op6_bpe_transducer", "op8_jump_shards", "op9_evidence_fusion", "op11_offset_pieces"}


def test_all_are_registered():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 1 + len(queries.queries()))]
    assert set(queries.queries()) - set(queries.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in check_oracle.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    line = check_oracle.compare(spark, connection, FOLDER, name, queries.queries()[name], queries.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_stages_keep_the_columns_and_agree_with_their_operators(spark):
    from collections import Counter

    from tokenizers import Tokenizer

    import public_tokenizers
    from tests_brute import jaccard_groups

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    everything = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(seen["language_id"]) == sorted(everything)  # all have a language
    last = {}
    for i, text in sorted(seen["language_id"]):
        last[text] = i
    assert sorted(seen["exact_dedup"]) == sorted((i, t) for t, i in last.items())
    groups = jaccard_groups(seen["exact_dedup"], 5, 80)
    assert sorted(i for i, _ in seen["near_dedup"]) == sorted(set(groups.values()))
    assert max(Counter(i for i, _ in seen["mix"]).values()) <= 2 and {i for i, _ in seen["mix"]} <= {i for i, _ in seen["near_dedup"]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    texts = dict(seen["mix"])
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in seen["mix"])
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
