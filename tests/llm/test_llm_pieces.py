import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from thematrail.llm import pieces as pc
from thematrail.llm.merging import Remembered, loads, merge_long, slices

PATH = public_tokenizers.path("piece_bpe_32k.model")
RANDOM = random.Random(3)
POOL = "abcdethe  \n\t▁.,<s>éÉ日本🦙\0　\x85​"
TEXTS = [
    "", " ", "   ", "▁", " ▁ ", "Hello world.", "a" * 3000, "the " * 200 + "x" * 300 + "日本語🦙" * 50, "<s> </s> <unk> <0x41>", "a\0b\r\n\tc",
    *("".join(RANDOM.choice(POOL) for _ in range(RANDOM.randrange(120))) for _ in range(400)),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_and_spans_equal_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(9999, None, "x"), (3, TEXTS[3], "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    texts = {i: t for i, t, _ in rows}
    got = pc.decode_pieces(pc.encode_pieces(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        expected = library.encode(text, return_type="proto").pieces
        assert r.ids == [p.id for p in expected], text
        assert list(zip(r.begins, r.ends)) == [(p.begin, p.end) for p in expected], text
        assert r.decoded == library.decode(r.ids)
    assert pc.encode_pieces(docs.limit(0), PATH).count() == 0


def test_digests_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in pc.digest_pieces(docs, PATH).collect():
        ids = library.encode(TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.aligned) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), True)


def test_slices_of_a_long_text_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pc, "LOAD_CHARS", 50)
    encoder = pc.PieceEncoder(pc.PieceModel(PATH), remembered=20)
    texts = [" ".join(TEXTS[10:]), "the  cat " * 100, "x" * 500]
    kept = []

    class Sink:
        def add(self, known, spans, opened, n_octets):
            kept.append([int(i) for k in known for i in memoryview(k[0]).cast("i")])

    pc._encode(texts, encoder, Sink())
    assert kept == [library.encode(t) for t in texts]


def test_decoding_any_ids_equals_the_library(library):
    decoder = pc.PieceDecoder(pc.PieceModel(PATH))
    for _ in range(2000):
        ids = [RANDOM.choice([RANDOM.randrange(259), RANDOM.randrange(32000)]) for _ in range(RANDOM.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trimmed", [True, False])
def test_compiled_maps_normalise_as_the_library_does(rule, trimmed):
    """By the longest prefix, with the original place of everything; the places are compared character by character."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trimmed)
    spec = dict(pc._fields(library.serialized_normalizer_spec()))

    class Rules:
        map = pc.CharacterMap(spec[2]) if spec.get(2) else None
        prefix, trimmed, escaped = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    own = pc.Normalizer(Rules)
    for _ in range(300):
        text = "".join(RANDOM.choice("ab ｱﾊﾞ①ﬁ　 éÉ\t\n㍿ẛ̣𝔸²½​") for _ in range(RANDOM.randrange(30)))
        normal, places = library.normalize(text, with_offsets=True)
        got, at = own.normalise(text)
        assert got == normal
        if at is not None:
            starts = [0]
            for c in got:
                starts.append(starts[-1] + len(c.encode()))
            assert [len(text.encode()[: at[s]].decode()) for s in starts] == list(places)


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as file:
        octets = file.read()
    trainer = next(v for k, v in pc._fields(octets) if k == 2)
    changed = trainer.replace(b"\x18\x02", b"\x18\x01", 1)  # model type 1: unigram
    (tmp_path / "m").write_bytes(octets.replace(trainer, changed, 1))
    with pytest.raises(ValueError):
        pc.PieceModel(str(tmp_path / "m"))


def test_long_words_merge_by_rank_from_the_left():
    pairs = {(0, 0): (0, 1), (1, 0): (1, 2), (1, 1): (2, 3)}
    assert merge_long([0] * 7, pairs) == [3, 2]
    assert merge_long([], pairs) == [] and merge_long([5], pairs) == [5]


def test_the_cache_is_bounded_and_keeps_what_is_asked_for():
    made = []
    cache = Remembered(lambda keys: made.append(list(keys)) or [k * 2 for k in keys], 4)
    for keys in ([1, 2, 3], [3, 4], [5, 6, 1], [1, 9, 9], list(range(20))):
        find = cache.get(keys)
        assert [find(k) for k in keys] == [2 * k for k in keys]
    assert len(cache.now) <= 20 and sum(map(len, made)) < 31


def test_slices_and_loads_hold_the_whole_texts():
    text = b"ab cd  efghijk l " * 9
    assert b"".join(slices(text, 10)) == text and len(list(slices(b"x" * 100, 10))) == 1
    dealt = [x for load in loads([text, b"", b"q"], 16) for x in load]
    assert [b"".join(p for r, p, _ in dealt if r == k) for k in range(3)] == [text, b"", b"q"]
    assert [sum(last for r, _, last in dealt if r == k) for k in range(3)] == [1, 1, 1]


def test_query_equals_the_library(spark, library):
    import duckdb

    from thematrail.llm import queries

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.queries()["op11_offset_pieces"](spark, folder).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        ids = library.encode(text or "")
        r = got.pop(i)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.aligned) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), True)
    assert not got
