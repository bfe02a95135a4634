import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thematrail.llm.bpe import BpeModel, Decoder, Encoder, decode_ids, encode_documents, sufficient_lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")
RANDOM = random.Random(11)
TEXTS = [
    "", " ", "Hello, World's 12 don't 're'll", "<|endoftext|>a<|startoftext|> <|endoftext", "ΑΣ ΣΑΣ Σ İ ß", "é é ́x", "日本語テキスト １２", "a\x1cb\x85c\xa0d e",
    "Ᲊ Ᲊ 𐵐 \U0001e5d0 \U000323b0", "thethethe" * 1500, "".join(RANDOM.choice("abcdehinorst") for _ in range(20000)),
    "".join(RANDOM.choice("éèçaeß") for _ in range(9000)), "!?" * 3000, "x" * 5000 + " y", "\n\t\r mixed \x0b\x0c end",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return BpeModel(PATH)


def test_encoding_and_decoding_equal_the_library(library, model):
    encoder, decoder = Encoder(model), Decoder(model)
    for text in TEXTS:
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text.encode())) == expected, text[:60]
        assert decoder.feed(expected) + decoder.finish() == library.decode(expected, skip_special_tokens=False)


def test_every_character_is_split_as_the_library_does(library, model):
    encoder = Encoder(model)
    for start in range(0, 0x110000, 97):
        c = chr(start)
        if not 0xD800 <= start < 0xE000:
            text = f"a{c}b 1{c}{c}"
            assert list(encoder.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_lookahead_makes_windows_agree_with_whole_words():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("c", "ab"), ("a", "cab"), ("ba", "b")]
    bound = sufficient_lookahead(merges)
    rng = random.Random(2)
    rank = {m: i for i, m in enumerate(merges)}

    def merged(text):
        parts = list(text)
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    for _ in range(3000):
        text = "".join(rng.choice("abc") for _ in range(60))
        cut = rng.randrange(bound, 60)
        whole, seen = merged(text), merged(text[:cut])
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        assert [e for e in ends(whole) if e <= cut - bound] == [e for e in ends(seen) if e <= cut - bound]


def test_no_bound_for_improper_merges():
    assert sufficient_lookahead([("ab", "c"), ("a", "b")]) is None
    assert sufficient_lookahead([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]) is None


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (3, TEXTS[3], "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_documents(docs.limit(0), PATH).count() == 0


def test_bytes_come_back(spark):
    docs = spark.createDataFrame([(1, "naïve café, 12 日本")], "doc_id bigint, text string")
    back = decode_ids(encode_documents(docs, PATH), PATH, as_bytes=True).first().decoded
    assert back == "naïve café , 1 2 日本 "


def test_query_digests(spark, library):
    import duckdb

    from thematrail.llm import queries

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.queries()["op6_bpe_transducer"](spark, folder).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got.pop(i)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert not got


def test_the_pipeline_returns_the_decoded_text(spark):
    from corpus_pipeline import tokenize

    texts = {1: "Some words, twice. Some words.", 2: "", 3: "élan 12 \n\n x" * 50}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in tokenize(spark, docs, "").collect()}
    library = Tokenizer.from_file(PATH)
    assert {i: r.decoded for i, r in got.items()} == {i: library.decode(r.ids, skip_special_tokens=False) for i, r in got.items()} and len(got) == 3
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got.values())
