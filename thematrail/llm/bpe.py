"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge list tells how far to the right the merges of a place can depend on the text:
``sufficient_lookahead`` computes that bound once. The encoder then merges a window, emits the tokens
that end at least that far before the window's end, since nothing that follows can change them, and slides on, so a
word of any length takes constant memory. The decoder feeds token bytes to an incremental byte-to-text machine.

The vocabulary file is the JSON of a ``tokenizers`` BPE model with the parts that ``BpeModel`` names;
others are refused. Its path is a parameter, its content is sent to the tasks as a broadcast (bounded: it is the
vocabulary, not data).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .merging import LONGEST, PairTable, Remembered, loads, merge_words, slices

#: White-space-delimited pieces whose tokens a task remembers, in two generations of this size.
REMEMBERED = 80_000

#: Bytes of text whose unseen words are merged together.
LOAD_BYTES = 1 << 19

#: Bytes of text that a task encodes before it hands rows on.
BATCH_BYTES = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b not in set(others) else chr(256 + others.index(b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int | None:
    """Symbols to the right of a token boundary that suffice to know that no text beyond them can move it.

    Run the merges over a text and over a prefix of it, rank by rank. At first they differ only where the prefix ends.
    The leftmost difference moves left only when a merge (u, v) takes place in one run alone, and then v reaches over the
    present difference. Just before, u was a token of both runs and it ended at the new one; so whichever merge moves
    the difference next has a higher rank and a right part that contains u. The bound is the longest such
    chain, each link as long as the way from the start of the right part to the end of u in it.

    None (no bound is known; words are then encoded whole) if a merge comes before one that makes its
    parts or if two merges make the same token.
    """
    made: dict[str, tuple[str, str]] = {}
    parts: dict[str, list[tuple[str, int]]] = {}

    def length(token: str) -> int:
        return len(token) - len(suffix) if suffix and token.endswith(suffix) and token != suffix else len(token)

    def constituents(token: str) -> list[tuple[str, int]]:
        if token not in parts:
            found = [(token, length(token))]
            if token in made:
                left, right = made[token]
                found += constituents(left) + [(t, end + length(left)) for t, end in constituents(right)]
            parts[token] = found
        return parts[token]

    results = {u + v for u, v in merges}
    if len(results) < len(merges):
        return None
    reach: dict[str, int] = {}
    for u, v in merges:
        if any(t in results and t not in made for t in (u, v)):
            return None
        moved = max([length(v), *(reach[t] + end for t, end in constituents(v) if t in reach)])
        reach[u] = max(reach.get(u, 0), moved)
        made[u + v] = (u, v)
    return max(reach.values(), default=0)


def _unassigned() -> str:
    """Characters that Python's Unicode tables do not know, as ranges of a character class."""
    ranges: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class BpeModel:
    """Vocabulary, merges and text rules, as plain data that can be sent to tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, normalizer, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = [x["type"] for x in normalizer.get("normalizers", [])]
        splits = pre.get("pretokenizers", [])
        if model["type"] != "BPE" or model.get("dropout") or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only lower-casing byte-level BPE that drops white space is read")
        if splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: unexpected pre-tokenizer, decoder or post-processor")
        self.pattern = splits[0]["pattern"]["Regex"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lookahead = sufficient_lookahead(self.merges, self.suffix)
        self.unknown = _unassigned()
        self.rules = json.dumps({
            "version": spec["version"], "normalizer": normalizer, "pre_tokenizer": pre, "added_tokens": [],
            "model": {"type": "BPE", "vocab": {}, "merges": []},
        })


def _lowered(text: str) -> str:
    """Composed and lower-cased; no final form of sigma."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    def __init__(self, model: BpeModel, remembered: int = REMEMBERED):
        self.lookahead = model.lookahead
        vocab, alphabet = model.vocab, byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + model.suffix] for c in alphabet], np.int32)
        self.width = len(vocab)
        self.separator = max(*vocab.values(), *model.special.values()) + 1  # stands between pieces
        self.rank, self.result = {}, []
        for u, v in model.merges:
            self.rank[vocab[u] * self.width + vocab[v]] = len(self.result)
            self.result.append(vocab[u + v])
        self.none = len(self.result)
        left, right = np.divmod(np.fromiter(self.rank, np.int64, len(self.rank)), self.width)
        order = np.fromiter(self.rank.values(), np.int32, len(self.rank))
        self.pairs = PairTable(left, right, order, np.array(self.result, np.int32)[order])
        self.size = [1] * self.width  # bytes of each token
        for token, i in vocab.items():
            self.size[i] = len(token) - len(model.suffix) if model.suffix and token.endswith(model.suffix) else len(token)
        self.words, self.lines = regex.compile(model.pattern), regex.compile(rf"\n|{model.pattern}")
        self.unknown = re.compile(f"[{model.unknown}]")
        self.rules = Tokenizer.from_str(model.rules)
        self.octet = {c: b for b, c in enumerate(alphabet)}
        self.special = model.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.pieces = Remembered(self.encoded, remembered)

    def merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        width, none, get = self.width, self.none, self.rank.get
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i) for i in range(len(ids) - 1) if (r := get(ids[i] * width + ids[i + 1], none)) < none]
        heapify(heap)
        while heap:
            best, at = heappop(heap)
            nxt = after[at]
            if ids[at] < 0 or nxt < 0 or get(ids[at] * width + ids[nxt], none) != best:
                continue  # one of the two has been merged meanwhile
            ids[at], ids[nxt] = self.result[best], -1
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (r := get(ids[left] * width + ids[after[left]], none)) < none:
                    heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def word(self, octets: bytes) -> Iterator[int]:
        """Token ids of one word, emitted once they are stable; holds two lookaheads of symbols at most."""
        step = max(self.lookahead or len(octets), 256)
        window: list[int] = []
        end = len(octets) - 1
        for start in range(0, end, step):
            window += self.inner[np.frombuffer(octets, np.uint8, min(step, end - start), start)].tolist()
            if start + step < end and self.lookahead is not None and len(window) > self.lookahead:
                stable, keep = len(window) - self.lookahead, 0
                for token in self.merged(window[:]):
                    if keep + self.size[token] > stable:
                        break
                    keep += self.size[token]
                    yield token
                del window[:keep]
        yield from self.merged([*window, int(self.last[octets[end]])])

    def odd(self, octets: bytes) -> Iterator[str | bytes | int]:
        """Words of a piece that may hold special strings (given as their ids) or characters younger than Python's tables."""
        text = octets.decode("utf-8", "replace")
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                yield self.special[part]
            elif self.unknown.search("".join(set(part))):  # the file's own rules split it
                pieces = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))
                yield from (bytes(map(self.octet.__getitem__, p)) for p, _ in pieces)
            else:
                yield from self.words.findall(_lowered(part))

    def split(self, pieces: list[bytes]) -> Iterator[str | bytes | int]:
        """Words of pieces without ASCII white space, a line feed after each piece, special strings as their ids."""
        whole = b"\n".join(pieces).decode("utf-8", "replace")
        if "<" not in whole and (whole.isascii() or not self.unknown.search("".join(set(whole)))):
            yield from self.lines.findall(_lowered(whole))
            yield "\n"
        elif len(pieces) == 1:
            yield from self.odd(pieces[0])
            yield "\n"
        else:  # narrow down to the pieces that hold such things
            for k in range(0, len(pieces), step := max(1, len(pieces) // 16)):
                yield from self.split(pieces[k : k + step])

    def tokens(self, pieces: list[bytes]) -> np.ndarray:
        """Token ids of pieces with ``separator`` after each; their distinct words are merged together, long ones streamed."""
        words = list(self.split(pieces))
        places = {word: k for k, word in enumerate(dict.fromkeys(words))}
        octets = [w.encode() if type(w) is str else w for w in places if type(w) is not int]
        short = np.fromiter((type(w) is not int and w != "\n" for w in places), bool, len(places))
        sizes = np.ones(len(places), np.int64)
        sizes[[k for k, w in enumerate(places) if type(w) is not int]] = list(map(len, octets))
        short &= sizes <= LONGEST
        if len(octets) < len(places) or not short.all():
            octets = [w.encode() if type(w) is str else w for w in places]
        joined = np.frombuffer(b"".join([w for w, s in zip(octets, short) if s]), np.uint8)
        symbols, ends = self.inner[joined], np.cumsum(sizes[short]) - 1
        symbols[ends] = self.last[joined[ends]]
        found, sizes[short] = merge_words(self.pairs, symbols, sizes[short])
        starts = np.zeros(len(places), np.int64)
        starts[short] = np.cumsum(sizes[short]) - sizes[short]
        others, at = [], len(found)
        for k in np.flatnonzero(~short).tolist():
            word = octets[k]
            own = [word] if type(word) is int else [self.separator] if word == b"\n" else list(self.word(word))
            starts[k], sizes[k] = at, len(own)
            others += own
            at += len(own)
        found = np.concatenate([found, np.array(others, np.int32)])
        codes = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        own = sizes[codes]
        return found[np.repeat(starts[codes] - np.cumsum(own) + own, own) + np.arange(own.sum())]

    def encoded(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece."""
        if not pieces:
            return []
        tokens = self.tokens(pieces)
        ends = np.flatnonzero(tokens == self.separator).tolist()
        tokens = tokens.tolist()
        return [tuple(tokens[a + 1 : b]) for a, b in zip([-1, *ends], ends)]

    def encode(self, octets: bytes) -> Iterable[int]:
        """Token ids of a whole text. No word, special string or composed character crosses ASCII white space."""
        for part in slices(octets, LOAD_BYTES):
            pieces = part.split()
            yield from chain.from_iterable(map(self.pieces.get(pieces), pieces))


class Decoder:
    """Incremental decoding: ids in, text out as soon as its bytes are complete.

    Without a decoder in the vocabulary file tokens are shown as they are stored, one space between them; with
    ``as_bytes`` they are turned back into the bytes they stand for, word ends into spaces.
    """

    def __init__(self, model: BpeModel, as_bytes: bool = False):
        self.as_bytes = as_bytes
        octet = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.bytes: dict[int, bytes] = {}
        for token, i in model.vocab.items():
            if as_bytes:
                ends = bool(model.suffix) and token.endswith(model.suffix)
                self.bytes[i] = b"".join(octet[c] for c in (token[: -len(model.suffix)] if ends else token)) + b" " * ends
            else:
                self.bytes[i] = token.encode()
        self.bytes |= {i: s.encode() for s, i in model.special.items()}
        ids = range(max(self.bytes) + 1)
        self.shown = [*[self.bytes.get(i, b"") for i in ids], b"\n"]
        self.decimal = [*[b"%d" % i for i in ids], b"\n"]
        self.restart()

    def restart(self) -> None:
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: Iterable[int]) -> str:
        between = b"" if self.as_bytes else b" "
        return self.feed_bytes(between.join(map(self.bytes.__getitem__, ids)))

    def feed_bytes(self, octets: bytes) -> str:
        """The text that the joined bytes of further tokens complete."""
        if octets and not self.first and not self.as_bytes:
            octets = b" " + octets
        self.first = self.first and not octets
        return self.machine.decode(octets)

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.restart()
        return text


class Ids:
    """Collects the ids of rows and, if asked for, the text decoded from them."""

    def __init__(self, encoder: Encoder, decoder: Decoder, decode: bool):
        self.pieces, self.decoder, self.decode = encoder.pieces, decoder, decode
        self.flat, self.offsets, self.texts, self.text = array("i"), array("i", [0]), [], []

    def feed(self, pieces: list[bytes], known: Callable) -> None:
        start = len(self.flat)
        self.flat.extend(chain.from_iterable(map(known, pieces)))
        if self.decode:
            self.text.append(self.decoder.feed(self.flat[start:]))

    def finish(self) -> None:
        self.offsets.append(len(self.flat))
        if self.decode:
            self.texts.append("".join(self.text) + self.decoder.finish())
            self.text = []

    def columns(self) -> list[pa.Array]:
        ids = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.flat, pa.int32()))
        return [ids, *([pa.array(self.texts, pa.string())] if self.decode else [])]


class Digests:
    """Digests of the ids and of the decoded text, fed piece by piece; neither is ever held as a whole.

    Remembered of a piece are its ids in decimal and the bytes of its tokens, which the decoder turns into text.
    """

    def __init__(self, encoder: Encoder, decoder: Decoder):
        def both(pieces: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
            if not pieces:
                return []
            tokens = encoder.tokens(pieces).tolist()
            ids, octets = (b" ".join(map(names.__getitem__, tokens)) for names in (decoder.decimal, decoder.shown))
            cut = lambda joined: [p.strip(b" ") for p in joined.split(b"\n")]  # noqa: E731  no token holds a line feed or begins or ends with a space
            return zip(cut(ids), cut(octets))

        encoder.pieces.make = both
        self.pieces, self.decoder, self.rows = encoder.pieces, decoder, []
        self._start()

    def _start(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, pieces: list[bytes], known: Callable) -> None:
        both = [k for k in map(known, pieces) if k[0]]
        if both:
            ids, octets = map(b" ".join, zip(*both))
            self.ids.update(b" " + ids if self.n else ids)
            self.text.update(self.decoder.feed_bytes(octets).encode())
            self.n += ids.count(b" ") + 1

    def finish(self) -> None:
        self.text.update(self.decoder.finish().encode())
        self.rows.append((self.n, self.ids.hexdigest(), self.text.hexdigest()))
        self._start()

    def columns(self) -> list[pa.Array]:
        n, ids, texts = zip(*self.rows)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]


_built: dict[tuple, tuple[Encoder, Decoder]] = {}


def _machines(model: BpeModel, *key) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of this worker; what the encoder remembers depends on the sink, which is part of the key."""
    if key not in _built:
        _built.clear()
        _built[key] = (Encoder(model, key[1]), Decoder(model))
    return _built[key]


def _batches(batches: Iterator[pa.RecordBatch], model, key: tuple, sink: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    encoder, decoder = _machines(model.value, *key)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).cast(pa.large_binary())
        ends, held = [0], 0
        for k, value in enumerate(texts):  # cut the batch by bytes
            held += len(value.as_buffer()) if value.is_valid else 0
            if held >= BATCH_BYTES:
                ends.append(k + 1)
                held = 0
        for start, stop in zip(ends, [*ends[1:], batch.num_rows]):
            if start == stop:
                continue
            out = sink(encoder, decoder)
            for load in loads((value.as_py() or b"" for value in texts.slice(start, stop - start)), LOAD_BYTES):
                found = [(part.split(), last) for _, part, last in load]
                known = out.pieces.get([p for own, _ in found for p in own])
                for own, last in found:
                    out.feed(own, known)
                    if last:
                        out.finish()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), *out.columns()], names=names)


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, remembered: int, kind: str, sink: Callable, out: str) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(BpeModel(path))
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = f"doc_id {dict(wanted.dtypes)['doc_id']}, {out}"
    names = [c.split()[0] for c in out.split(", ")]
    return wanted.mapInArrow(lambda batches: _batches(batches, model, (path, remembered, kind), sink, names), out)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Token ids of every whole text: (doc_id, ids array<int>) and, with ``decode``, the text decoded from the ids.

    As the ``tokenizers`` library encodes with add_special_tokens=False and decodes with skip_special_tokens=False.
    Null and empty texts have no ids and the empty decoded text; other columns are left out; repeated rows are
    encoded each. Rows stay in their partitions: there is no shuffle. A task holds one Arrow batch, a bounded
    cache of ``remembered`` entries and ``BATCH_BYTES`` of output, and of a word twice the lookahead.
    """
    out = "ids array<int>" + ", decoded string" * decode
    return _mapped(docs, path, doc_id, text, remembered, "ids", lambda encoder, decoder: Ids(encoder, decoder, decode), out)


def digest_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """What ``encode_documents`` gives, as (doc_id, n_tokens, ids_sha256, decoded_sha256).

    The digests (of the decimal ids joined by one space, and of the decoded text) are fed in the task slice by slice: beside the text itself a
    text of any length takes the memory of ``LOAD_BYTES`` of it.
    """
    return _mapped(docs, path, doc_id, text, remembered, "digests", Digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", as_bytes: bool = True) -> DataFrame:
    """Add ``decoded``, the text of the token ids (null ids: empty), to the columns of ``encoded``."""
    model = encoded.sparkSession.sparkContext.broadcast(BpeModel(path))

    @F.pandas_udf("string")
    def decoded(column):
        machine = Decoder(model.value, as_bytes)
        return column.map(lambda x: machine.feed([] if x is None else x) + machine.finish())

    return encoded.withColumn("decoded", decoded(F.col(ids)))
