"""SentencePiece BPE encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; every normalised byte
remembers the original byte that it came from. The normalised text is cut where no piece of the vocabulary can reach
across, so that each part merges on its own (the pair with the best-scored piece first, the leftmost of equals),
and every piece is projected back to the bytes of the original text.

The model file is a SentencePiece model of kind BPE without symbols of the user; others are refused. Its path is a
parameter, its content is sent to the tasks as a broadcast (bounded: it is the vocabulary, not data).
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import LONGEST, PairTable, Remembered, merge_long, merge_words

#: Parts of text whose tokens a task remembers, in two generations of this size.
REMEMBERED = 80_000

#: Characters of text whose unseen parts are merged together; bytes of text that a task encodes before it hands rows on.
LOAD_CHARS, BATCH_BYTES = 1 << 19, 1 << 20

SPACE = "▁"

#: A lone surrogate, which no decoded text holds, stands between parts.
CUT = "\ud800"

codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))

# Fixed values of the model format: kinds of pieces, kind of model.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
BPE = 2


def _fields(octets: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = octets[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(octets):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, octets[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie from byte strings to their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units = array("I", blob[4 : 4 + size])
        self.strings = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes]] = {}
        self.leads = bytes(b for b in range(256) if self._step(self._offset(0), b) is not None)
        self.start = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in self.leads) + b"]") if self.leads else None

    def _offset(self, place: int) -> int:
        unit = self.units[place]
        return place ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, octet: int) -> int | None:
        """Place of the child for a byte; None if there is none."""
        place = base ^ octet
        return place if place < len(self.units) and self.units[place] & 0x800000FF == octet else None

    def longest(self, octets: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix at a place."""
        found, base = None, self._offset(0)
        for k in range(at, len(octets)):
            place = self._step(base, octets[k])
            if place is None:
                break
            base = self._offset(place)
            if self.units[place] >> 8 & 1:
                found = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.strings[start : self.strings.index(b"\0", start)]


class PieceModel:
    """Vocabulary and text rules, as plain data that can be sent to tasks."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer = dict(_fields(next(v for k, v in parts if k == 2)))
        rules = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        pieces = [dict(_fields(v)) for k, v in parts if k == 1]
        self.pieces = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        self.scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        if trainer.get(3) != BPE or trainer.get(24) or not set(self.kinds) <= {NORMAL, UNKNOWN, 3, BYTE}:
            raise ValueError(f"{path}: only BPE models without symbols of the user and with spaces before words are read")
        self.fallback = bool(trainer.get(35))
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.prefix, self.trimmed, self.escaped = (bool(rules.get(k, 1)) for k in (3, 4, 5))


class Normalizer:
    """Normalised text and, unless it is the text itself with its spaces escaped, where its bytes come from."""

    def __init__(self, model: PieceModel):
        self.map, self.prefix, self.trimmed = model.map, model.prefix, model.trimmed
        self.space = (SPACE if model.escaped else " ").encode()
        self.plain = not model.map and not model.trimmed and model.escaped

    def _steps(self, octets: bytes) -> Iterator[tuple[int, bytes, int]]:
        """(place, normalised bytes, length of the original): by the longest prefix of the map or one character."""
        at = 0
        while at < len(octets):
            if self.map and (found := self.map.longest(octets, at)):
                yield at, found[1], found[0]
                at += found[0]
                continue
            length = 1
            while at + length < len(octets) and octets[at + length] & 0xC0 == 0x80:
                length += 1
            yield at, octets[at : at + length], length
            at += length

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The text with a space before it and spaces escaped; for each of its bytes and its end the original byte.

        None instead of the places says that each space sign stands for one space (the first for nothing)
        and all else for itself.
        """
        if not text:
            return "", None
        if self.plain and SPACE not in text:
            spaced = text.replace(" ", SPACE)
            return SPACE + spaced if self.prefix else spaced, None
        octets = text.encode()
        out, places, space = bytearray(), array("q"), self.space
        steps = list(self._steps(octets))
        first, last = 0, len(steps)
        if self.trimmed:
            while first < last and steps[first][1] == b" ":
                first += 1
        if first == last:
            return "", np.zeros(1, np.int64)
        consumed = steps[first][0]
        if self.prefix:
            out += space
            places.extend([consumed] * len(space))
        follows = self.trimmed  # a space comes right before
        for place, normal, length in steps[first:]:
            if self.trimmed and follows:
                normal = normal.lstrip(b" ")
            for piece in re.findall(b" |[^ ]+", normal):
                add = space if piece == b" " else piece
                out += add
                places.extend([place] * len(add))
            if normal:
                follows = self.trimmed and normal.endswith(b" ")
            consumed = place + length
        if self.trimmed:
            while out.endswith(space):
                consumed = places[len(out) - len(space)]
                del out[len(out) - len(space) :], places[-len(space) :]
        places.append(consumed)
        return out.decode(), np.frombuffer(places, np.int64)


class PieceDecoder:
    """Ids to text, run by run: neighbouring byte pieces are read as UTF-8, every byte that is none becomes U+FFFD."""

    def __init__(self, model: PieceModel):
        self.octets = {i: bytes([int(p[3:5], 16)]) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        shown = {NORMAL: lambda p: p.replace(SPACE, " "), UNKNOWN: lambda p: model.unknown_text}
        self.texts = [shown.get(k, lambda p: "")(p) for p, k in zip(model.pieces, model.kinds)]
        self.prefix, self.trimmed, self.unknown = model.prefix, model.trimmed, model.unknown

    def inner(self, ids: Iterable[int]) -> str:
        """Text of ids that are not the first of a text."""
        out = []
        for is_octet, run in groupby(ids, self.octets.__contains__):
            if is_octet:
                out.append(b"".join(map(self.octets.__getitem__, run)).decode("utf-8", "each-byte"))
            else:
                out.extend(map(self.texts.__getitem__, run))
        return "".join(out)

    def opened(self, text: str) -> str:
        """An encoded and decoded text without the space that encoding put before it."""
        return text[1:] if (self.prefix or self.trimmed) and text.startswith(" ") else text

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; pieces lose a space sign at their beginning while there is no text yet, one in all unless spaces were trimmed."""
        for k, i in enumerate(ids if self.prefix or self.trimmed else ()):
            if i in self.octets or i == self.unknown:
                return self.inner(ids[k:])
            text = self.texts[i]
            spaced = text.startswith(" ")
            if text[spaced:] or spaced and not self.trimmed:
                return text[spaced:] + self.inner(ids[k + 1 :])
        return "" if self.prefix or self.trimmed else self.inner(ids)


class PieceEncoder:
    def __init__(self, model: PieceModel, remembered: int = REMEMBERED):
        self.model, self.normalizer, self.decoder = model, Normalizer(model), PieceDecoder(model)
        own = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.n = len(model.pieces)
        self.symbols = dict(own)  # and the characters that occur in longer pieces only
        for c in sorted({c for piece in own for c in piece}.difference(own)):
            self.symbols[c] = self.n + len(self.symbols) - len(own)
        self.other = self.n + len(self.symbols) - len(own)  # any character that occurs in no piece
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in own.values()}, reverse=True))}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, i in own.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    self.pair[a, b] = order[model.scores[i]], i
        pairs, results = np.array(list(self.pair), np.int64).reshape(-1, 2), np.array(list(self.pair.values()), np.int32).reshape(-1, 2)
        self.pairs = PairTable(pairs[:, 0], pairs[:, 1], results[:, 0], results[:, 1])
        # no merge reaches across two characters that stand side by side in no piece
        self.adjacent = {piece[k : k + 2] for piece in own for k in range(len(piece) - 1)}
        self.spaced = not any(x[1] == SPACE != x[0] for x in self.adjacent)
        self.loose = [c for c in "\n\r\t" if not any(c in x for x in self.adjacent)]
        loose = "".join(self.loose)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{loose}]+|{SPACE}+" + (f"|[{loose}]" if loose else "") if self.spaced else r"(?s).+")
        self.octet_ids = [model.pieces.index(f"<0x{b:02X}>") for b in range(256)] if model.fallback else None
        self.bytes = np.array([len(p.encode()) for p in model.pieces] + [0], np.int32)
        self.decimal = [*[b"%d" % i for i in range(self.n)], b"\n"]
        self.shown = [*self.decoder.texts, CUT]
        self.remembered = Remembered(self.made, remembered)

    def split(self, normal: str, plain: bool) -> list[str]:
        """Parts of a normalised text that merge on their own."""
        if not plain or not self.spaced or SPACE + SPACE in normal:
            return self.parts.findall(normal)
        for c in self.loose:
            if c in normal:
                normal = normal.replace(c, f"{CUT}{c}{CUT}")
        return [p for p in normal.replace(SPACE, CUT + SPACE).split(CUT) if p]

    def _merged_long(self, part: str) -> list[int]:
        cuts = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.adjacent), len(part)]
        found: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            found += merge_long([self.symbols.get(c, self.other) for c in part[a:b]], self.pair)
        return found

    def made(self, parts: list[str]) -> Iterable[tuple[bytes, bytes, str, bytes]]:
        """For each part: ids (int32), ids in decimal, text decoded from them, and how far each piece reaches (see ``spread``)."""
        if not parts:
            return []
        made: dict[str, tuple] = {}
        short = [p for p in parts if len(p) <= LONGEST]
        text = "".join(short)
        kinds = {c: self.symbols.get(c, self.other) for c in set(text)}
        symbols = np.fromiter(map(kinds.__getitem__, text), np.int32, len(text))
        found, sizes = merge_words(self.pairs, symbols, np.fromiter(map(len, short), np.int64, len(short)))
        stops = np.cumsum(sizes)
        odd = np.unique(np.searchsorted(stops, np.flatnonzero(found >= self.n), "right"))
        for k in odd.tolist():
            made[short[k]] = self._odd(short[k], found[stops[k] - sizes[k] : stops[k]].tolist())
        for part in parts:
            if len(part) > LONGEST:
                made[part] = self._odd(part, self._merged_long(part))
        plain = np.ones(len(short), bool)
        plain[odd] = False
        found, sizes = found[np.repeat(plain, sizes)], sizes[plain]
        octets, lengths = found.tobytes(), self.bytes[found].tobytes()
        stops = np.cumsum(sizes)
        tokens = np.insert(found, stops, self.n).tolist()  # n stands between parts
        decimal = [d.strip(b",") for d in b",".join(map(self.decimal.__getitem__, tokens)).split(b"\n")]
        shown = "".join(map(self.shown.__getitem__, tokens)).split(CUT)
        stops = (4 * stops).tolist()
        cut = zip(decimal, shown, [0, *stops], stops)
        made |= {p: (octets[a:b], d, t, lengths[a:b]) for p, (d, t, a, b) in zip([p for p, x in zip(short, plain) if x], cut)}
        return map(made.__getitem__, parts)

    def _odd(self, part: str, own: list[int]) -> tuple[bytes, bytes, str, bytes]:
        """A part with characters that are no pieces: they fall back to their bytes or are unknown, neighbours being one unknown piece."""
        ids, spans, char = array("i"), array("i"), 0
        for symbol in own:
            if symbol < self.n:
                ids.append(symbol)
                spans.append(int(self.bytes[symbol]))
                char += len(self.model.pieces[symbol])
                continue
            octets = part[char].encode()
            char += 1
            if self.octet_ids is not None:
                ids.extend([self.octet_ids[b] for b in octets])
                spans.extend([0] * (len(octets) - 1) + [len(octets)])
            elif ids and ids[-1] == self.model.unknown:
                spans[-1] += len(octets)
            else:
                ids.append(self.model.unknown)
                spans.append(len(octets))
        return ids.tobytes(), b",".join(map(self.decimal.__getitem__, ids)), self.decoder.inner(ids), spans.tobytes()

    def slices(self, normal: str, plain: bool) -> Iterator[list[str]]:
        """Parts of a normalised text in loads of about ``LOAD_CHARS``."""
        start = 0
        while self.spaced and len(normal) - start > LOAD_CHARS:
            cut = normal.find(SPACE, start + LOAD_CHARS)
            while cut > 0 and normal[cut - 1] == SPACE:
                cut = normal.find(SPACE, cut + 1)
            if cut < 0:
                break
            yield self.split(normal[start:cut], plain)
            start = cut
        yield self.split(normal[start:] if start else normal, plain)

    def places(self, normal: str, places: np.ndarray | None) -> np.ndarray:
        """The original byte of every normalised byte and of the end."""
        if places is not None:
            return places
        octets = np.frombuffer(normal.encode(), np.uint8)
        shift = np.zeros(len(octets) + 1, np.int64)  # each space sign has two bytes more than its space, an added one three more than nothing
        at = np.flatnonzero(octets == 0xE2)
        shift[at[(octets[at + 1] == 0x96) & (octets[at + 2] == 0x81)] + 3] = 2
        if self.normalizer.prefix and len(octets):
            shift[3] = 3
        return np.arange(len(octets) + 1) - np.cumsum(shift)


def spread(spans: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of pieces in the normalised bytes, from their lengths."""
    lengths = np.frombuffer(spans, np.int32).astype(np.int64)
    ends = np.cumsum(lengths)
    return ends - lengths, ends


class Pieces:
    """Collects ids and original byte spans of rows."""

    names = "ids array<int>, begins array<bigint>, ends array<bigint>"

    def __init__(self, encoder: PieceEncoder):
        self.rows: list[tuple] = []

    def add(self, known: list[tuple], spans: tuple[np.ndarray, np.ndarray], opened: Callable, n_octets: int) -> None:
        self.rows.append((np.frombuffer(b"".join([k[0] for k in known]), np.int32), *spans))

    def columns(self) -> list[pa.Array]:
        offsets = pa.array([0, *accumulate(len(r[0]) for r in self.rows)], pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(column), kind)) for column, kind in zip(zip(*self.rows), (pa.int32(), pa.int64(), pa.int64()))]


class PieceDigests:
    """Digests of the decimal ids and of the decoded text of rows, and whether their pieces cover the original bytes without gap or overlap."""

    names = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, aligned boolean"

    def __init__(self, encoder: PieceEncoder):
        self.rows: list[tuple] = []

    def add(self, known: list[tuple], spans: tuple[np.ndarray, np.ndarray], opened: Callable, n_octets: int) -> None:
        ids = b",".join([k[1] for k in known if k[1]])
        text = opened("".join([k[2] for k in known]))
        begins, ends = spans
        aligned = bool(begins[0] == 0 and ends[-1] == n_octets and (begins[1:] == ends[:-1]).all()) if len(begins) else not n_octets
        self.rows.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), aligned))

    def columns(self) -> list[pa.Array]:
        return [pa.array(c, k) for c, k in zip(zip(*self.rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))]


_built: dict[tuple, PieceEncoder] = {}


def _batches(batches: Iterator[pa.RecordBatch], model, key: tuple, sink: type, names: list[str]) -> Iterator[pa.RecordBatch]:
    if key not in _built:
        _built.clear()
        _built[key] = PieceEncoder(model.value, key[1])
    encoder = _built[key]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).cast(pa.large_binary())
        start, held = 0, 0
        for row, value in enumerate(texts):
            held += len(value.as_buffer()) if value.is_valid else 0
            if held >= BATCH_BYTES or row + 1 == batch.num_rows:
                out = sink(encoder)
                _encode([(v.as_py() or b"").decode("utf-8", "replace") for v in texts.slice(start, row + 1 - start)], encoder, out)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, row + 1 - start), *out.columns()], names=names)
                start, held = row + 1, 0


def _encode(texts: list[str], encoder: PieceEncoder, out) -> None:
    """Encode texts of about ``BATCH_BYTES`` together (one text alone if it is longer), their unseen parts in loads."""
    normals = [encoder.normalizer.normalise(text) for text in texts]
    known: list[list[tuple]] = [[] for _ in texts]
    load: list[tuple[int, list[str]]] = []
    held = 0

    def settle() -> None:
        find = encoder.remembered.get([p for _, parts in load for p in parts])
        for row, parts in load:
            known[row].extend(map(find, parts))
        load.clear()

    for row, (normal, places) in enumerate(normals):
        for parts in encoder.slices(normal, places is None):
            load.append((row, parts))
            held += min(len(normal), LOAD_CHARS)
            if held >= LOAD_CHARS:
                settle()
                held = 0
    settle()
    for text, (normal, places), own in zip(texts, normals, known):
        begins, ends = spread(b"".join([k[3] for k in own]))
        places = encoder.places(normal, places)
        out.add(own, (places[begins], places[ends]), encoder.decoder.opened, len(text.encode()))


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, remembered: int, sink: type) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path))
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = f"doc_id {dict(wanted.dtypes)['doc_id']}, {sink.names}"
    names = [c.split()[0] for c in out.split(", ")]
    return wanted.mapInArrow(lambda batches: _batches(batches, model, (path, remembered), sink, names), out)


def encode_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of every whole text: (doc_id, ids, begins, ends), the last two in bytes of the original UTF-8 text.

    Ids are those of the ``sentencepiece`` library without begin or end ids and without sampling. A piece spans what it was normalised from; the space
    put before a text spans nothing, and of the byte pieces of a character the last spans it, the others nothing. Null and empty texts have no pieces; other columns
    are left out; repeated rows are encoded each. Rows stay in their partitions: there is no shuffle. A task
    holds one Arrow batch, a bounded cache of ``remembered`` parts and the ids and spans of ``BATCH_BYTES`` of text or of one longer text.
    """
    return _mapped(docs, path, doc_id, text, remembered, Pieces)


def digest_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """What ``encode_pieces`` and ``decode_pieces`` give, as (doc_id, n_tokens, ids_sha256, decoded_sha256, aligned).

    The digests are those of the decimal ids joined by commas and of the decoded text; ``aligned`` says whether the pieces cover the
    original bytes in order, without gap or overlap (false where normalisation drops something).
    """
    return _mapped(docs, path, doc_id, text, remembered, PieceDigests)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids (null ids: empty), to the columns of ``encoded``."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel(path))

    @F.pandas_udf("string")
    def decoded(column):
        decoder = PieceDecoder(model.value)
        return column.map(lambda x: "" if x is None else decoder.decode(x))

    return encoded.withColumn("decoded", decoded(F.col(ids)))
