import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from thematrail.llm.exact import DigestIndex, exact_dedup, without_copies
from thematrail.llm.mixing import mix_sources, mixed_documents, source_targets
from thematrail.llm.shards import jump, shard_documents

DOCS = "doc_id bigint, text string, lang string, source string, keep_id string, row string, digest string, shard string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, "k", "r", "d", "s") for i, t, s in rows], DOCS)


ROWS = [(1, "a", "x"), (2, "a", "y"), (3, "A", None), (4, None, "x"), (5, "", "x"), (6, "long " * 5000, "x"), (6, "long " * 5000, "x"), (None, "a", "y"), (None, "b", "y")]


def test_exact_keeps_the_largest_id_of_each_text(spark):
    got = exact_dedup(docs_of(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for i, t, _ in ROWS:
        by.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(i)
    for r in got:
        ids = by[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty_table(spark):
    empty = docs_of(spark, ROWS).limit(0)
    assert exact_dedup(empty).count() == 0
    assert without_copies(empty).columns == empty.columns


def test_later_loads_lose_to_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    first = {r.doc_id: r for r in index.load(docs_of(spark, [(1, "a", "x"), (2, "b", "x")])).collect()}
    assert first[1].kept and first[2].kept
    later = {r.doc_id: r for r in index.load(docs_of(spark, [(1, "a", "x"), (9, "a", "x"), (8, "c", "x")])).collect()}
    assert not later[1].kept and not later[9].kept and later[9].keep_id == 1 and later[8].kept
    assert index.read().count() == 3


def decisions(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_a_repeated_load_gives_the_same_rows(spark):
    index = DigestIndex(spark, buckets=4)
    index.load(docs_of(spark, [(5, "old", "x")]), load_id="first").count()
    docs = docs_of(spark, [(1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "old", "x"), (6, None, "x")])
    want = [(1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (4, 5, 1, False), (6, 6, 1, True)]
    assert decisions(index.load(docs, load_id="second")) == want
    assert decisions(index.load(docs, load_id="second")) == want  # its rows were lost after the append
    assert index.read().count() == 4
    assert {r[3] for r in decisions(index.load(docs, load_id="third"))} == {False}
    assert {r[3] for r in decisions(index.load(docs))} == {False} and index.read().count() == 4


def test_a_load_cut_off_within_its_append_is_completed(spark):
    docs = docs_of(spark, [(i, f"text {i % 7}", "x") for i in range(20)])
    index = DigestIndex(spark, buckets=4)
    append = index.append

    def lost(fresh):
        append(fresh.filter("keep_id % 2 = 0"))
        raise RuntimeError("lost")

    index.append = lost
    with pytest.raises(RuntimeError):
        index.load(docs, load_id="x")
    assert 0 < index.read().count() < 7
    index.append = append
    got = decisions(index.load(docs, load_id="x"))
    assert got == sorted((i, i % 7 + 7 * ((19 - i % 7) // 7), sum(j % 7 == i % 7 for j in range(20)), i >= 13) for i in range(20))
    assert index.read().count() == 7


def test_an_index_is_opened_by_its_path_and_compacted(spark, tmp_path, plan):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=4)
    for n in range(3):
        index.load(docs_of(spark, [(i, f"text {i}", "x") for i in range(10 * n, 10 * n + 20)]), load_id=str(n)).count()
    before = sorted(index.read().collect())
    index.close()
    other = DigestIndex(spark, path, buckets=64)
    assert other.buckets == 4 and sorted(other.read().collect()) == before and len(before) == 40
    other.compact(8)
    assert other.buckets == 8 and sorted(other.read().collect()) == before
    assert 0 < len(list((tmp_path / "index").glob(f"{other.folder.split('/')[-1]}/*.parquet"))) <= 8
    again = DigestIndex(spark, path)
    assert again.buckets == 8 and sorted(again.read().collect()) == before
    assert [r.kept for r in again.load(docs_of(spark, [(1, "text 5", "x"), (2, "new", "x")])).orderBy("doc_id").collect()] == [False, True]


def test_index_is_read_without_a_shuffle(spark, plan):
    index = DigestIndex(spark, buckets=8)
    index.load(docs_of(spark, ROWS)).count()
    joined = index.read().hint("merge").join(spark.range(3).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")), "digest")
    assert plan(joined).count("Exchange") == 1


def test_without_copies_keeps_columns_and_one_row_a_text(spark):
    docs = docs_of(spark, ROWS)
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t, _ in ROWS})


def jump_reference(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_scalar_loop_and_moves_only_to_the_new_shard():
    import numpy as np

    keys = [0, 1, 2, 2**63 - 1, -1, *(random.Random(3).randrange(-(2**63), 2**63) for _ in range(500))]
    octets = np.array(keys, np.int64).view(np.uint64)
    before, after = jump(octets, 16), jump(octets, 17)
    assert before.tolist() == [jump_reference(k % 2**64, 16) for k in keys]
    assert all(a == b or a == 16 for a, b in zip(after, before))
    assert set(jump(octets, 1)) == {0}


def test_a_repeated_key_or_row_is_never_one_group(spark):
    rows = [(7, f"text {i % 150}", "x") for i in range(300)] + [(7, "same", "x")] * 200 + [(None, "same", "x")] * 90 + [(i, "b", "y") for i in range(300)]
    got = shard_documents(docs_of(spark, rows), 4, block_rows=20).collect()
    want = sorted((-1 if i is None else i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in got if r.doc_id == 7} == {int(jump_reference(7, 4))}


def test_shards_have_gapless_slots(spark):
    rows = [*ROWS, *((i, f"t{i}", "x") for i in range(100, 400))]
    got = shard_documents(docs_of(spark, rows), 16, block_rows=7).collect()
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = {i: t for i, t, _ in rows}
    for r in got:
        text = (texts[r.doc_id] or "").encode() if r.doc_id is not None else None
        assert r.law == "key" and r.shard == jump_reference(r.doc_id or 0, 16) and r.grown_shard == jump_reference(r.doc_id or 0, 17)
        if text is not None:
            assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
    assert shard_documents(docs_of(spark, rows).limit(0)).count() == 0


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    target, open_names, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_names:
        level = rest / sum(weight[n] for n in open_names)
        over = {n for n in open_names if level * weight[n] > 2 * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in open_names}
        for n in over:
            target[n] = 2.0 * sizes[n]
            rest -= target[n]
        open_names -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 10}, {"a": 1, "b": 1000, "c": 3, "d": 7, "é": 90}, {"a": 0, "b": 0}, {"x": 5}])
def test_targets_equal_repeated_resharing(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_mix_meets_targets_repeats_and_prefers_quality(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 9), "abcde"[i % 5] if i % 11 else None) for i in range(3000)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 3000)], "doc_id bigint, quality int")
    got = mix_sources(docs, labels, bin_rows=50).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs, labels, bin_rows=3000).collect()), key=repr)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
        assert {r.copies for r in own} <= {int(own[0].target // own[0].source_size) + k for k in (0, 1)}
    drawn = [r for r in got if r.copies and 0 < r.target < r.source_size]
    assert sum(r.doc_id % 2 for r in drawn) > 0.6 * len(drawn)
    mixed = mixed_documents(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_of_odd_rows(spark):
    got = mix_sources(docs_of(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got)
    assert [r.size for r in got if r.doc_id == 4] == [0]
    assert mix_sources(docs_of(spark, ROWS).limit(0)).count() == 0
