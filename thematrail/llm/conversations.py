"""Repair of conversation structure by a dynamic program over a grammar of role and fault sequences.

Every row of a conversation becomes a symbol (its role and its fault). A repair is a way through the automaton of
``(system? (user assistant)+)?``; what a row can do to its four states is a min-plus matrix of costs. Frequent pairs of symbols
of all conversations become rules (Re-Pair, several pairs a round), and the matrix of a rule is worked out once from those of its parts. With each entry goes
a rope, the state in the middle, from which the edits can be read later, and its place among the entries' edit strings in
ASCII order. The edits of a row are inserts followed by one of keep, rerole or delete, so no edit string of a run of rows begins
another one of the same run, and two strings over two runs compare as the pairs of their places do: no string is needed to settle ties.

Conversations are cut into segments by a range sort, so one with very many rows is spread over many tasks;
only the small matrices of its segments meet in one task. The digest of a repaired conversation is sequential by
nature: its rows pass through one task, in order and one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import written

#: Rows of a segment; rounds of pairing and rules added in a round.
SEGMENT, ROUNDS, RULES = 16_384, 8, 12

#: Sequences of up to so many symbols are remembered by a task, so many of them.
REMEMBERED_LENGTH, REMEMBERED = 64, 20_000

SPACES = " \t\n\x0b\x0c\r"

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60

#: Where a role of each initial leads, and how many inserts end a conversation.
MOVES = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 1, 2, 3, 2


def _next(state: int) -> tuple[int, str]:
    """The state after the user or assistant row that may follow, and its role."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def symbol(initial: str, deleted: bool, truncated: bool) -> str:
    return "D" if deleted else (initial if initial in ("s", "u", "a") else "x").upper() if truncated else initial if initial in ("s", "u", "a") else "x"


class Matrix:
    """Least costs between states, places of their edit strings in ASCII order, and the states in the middle (None in a terminal)."""

    __slots__ = ("cost", "place", "middle")

    def __init__(self, cost: list[int], keys: list, middle: list[int] | None = None):
        order = {key: k for k, key in enumerate(sorted({key for key, c in zip(keys, cost) if c < FAR}))}
        self.cost, self.middle = cost, middle
        self.place = [order[key] if c < FAR else -1 for key, c in zip(keys, cost)]

    def then(self, other: "Matrix") -> "Matrix":
        cost, keys, middle = [], [], []
        for p in STATES:
            for q in STATES:
                best = min((self.cost[4 * p + r] + other.cost[4 * r + q], self.place[4 * p + r], other.place[4 * r + q], r) for r in STATES)
                cost.append(min(best[0], FAR))
                keys.append(best[1:3])
                middle.append(best[3])
        return Matrix(cost, keys, middle)


@lru_cache(maxsize=None)
def edits(terminal: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and edit string of a row, inserts before it included, between states."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for p in STATES:
        state = p
        for inserts in range(3):
            own = [(DELETE, "D", state)]
            if terminal != "D":
                extra = KEEP_TRUNCATED if terminal.isupper() else 0
                kept = MOVES.get((terminal.lower(), state))
                own += [(extra, "K", kept)] * (kept is not None) + [(REROLE + extra, "R", _next(state)[0])]
            for cost, letter, q in own:
                option = (cost + INSERT * inserts, "I" * inserts + letter)
                found[p, q] = min(found.get((p, q), option), option)
            state = _next(state)[0]
    return found


class Grammar:
    """Rules (left, right, symbol) over the terminals, each with its matrix, worked out from the bottom up."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.parts = {new: (left, right) for left, right, new in rules}
        self.matrices: dict[str, Matrix] = {}
        self.found: dict[str, tuple[list[str], list[Matrix]]] = {}
        self.ropes: dict[tuple[str, int, int], str] = {}
        for terminal in "suaxSUAXD":
            own = edits(terminal)
            pairs = [(p, q) for p in STATES for q in STATES]
            self.matrices[terminal] = Matrix([own[x][0] if x in own else FAR for x in pairs], [own[x][1] if x in own else "" for x in pairs])
        for left, right, new in rules:
            self.matrices[new] = self.matrices[left].then(self.matrices[right])

    def compressed(self, symbols: str) -> str:
        for left, right, new in self.rules:
            if left in symbols:
                symbols = symbols.replace(left + right, new)
        return symbols

    def prefixes(self, symbols: str) -> tuple[str, list[Matrix]]:
        """The compressed sequence and the matrices of its beginnings; short sequences are remembered."""
        known = self.found.get(symbols)
        if known is None:
            packed = self.compressed(symbols)
            matrices = [self.matrices[packed[0]]]
            for s in packed[1:]:
                matrices.append(matrices[-1].then(self.matrices[s]))
            known = packed, matrices
            if len(symbols) <= REMEMBERED_LENGTH:
                if len(self.found) >= REMEMBERED:
                    self.found.clear()
                self.found[symbols] = known
        return known

    def rope(self, s: str, p: int, q: int) -> str:
        """Edit string of a symbol between two states."""
        if s not in self.parts:
            return edits(s)[p, q][1]
        key = s, p, q
        if key not in self.ropes:
            left, right = self.parts[s]
            r = self.matrices[s].middle[4 * p + q]
            self.ropes[key] = self.rope(left, p, r) + self.rope(right, r, q)
        return self.ropes[key]

    def audit(self, symbols: str, p: int, q: int) -> str:
        packed, matrices = self.prefixes(symbols)
        found = []
        for k in range(len(packed) - 1, 0, -1):
            r = matrices[k].middle[4 * p + q]
            found.append(self.rope(packed[k], r, q))
            q = r
        found.append(self.rope(packed[0], p, q))
        return "".join(reversed(found))


def ending(matrix: Matrix) -> tuple[int, int]:
    """Least cost of a whole conversation and the state before the inserts that end it."""
    cost, _, q = min((matrix.cost[q] + INSERT * ENDING[q], matrix.place[q], q) for q in STATES)
    return cost, q


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names, columns = batch.schema.names, [batch.column(c) for c in batch.schema.names]
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(names, columns)}


def _tabled(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _segments(rows: Iterator[dict], size: int) -> Iterator[tuple]:
    """Runs of up to ``size`` rows of one conversation: its rows come grouped (``n`` equal ones) and in order."""
    part, at = TaskContext.get().partitionId(), 0
    own: dict | None = None

    def done() -> tuple:
        nonlocal at
        at += 1
        return (
            own["conv_id"], own["turn"], own["role"], own["digest"], part, at, "".join(own["symbols"]),
            own["first"], own["last"], *(own[c] for c in COUNTS), own["low"], own["high"], own["turns"],
        )

    for row in rows:
        initial, turn = row["role"][:1], row["turn"]
        for copy in range(row["n"]):
            if own is None or own["conv_id"] != row["conv_id"] or len(own["symbols"]) >= size:
                if own is not None:
                    yield done()
                own = {c: row[c] for c in ("conv_id", "turn", "role", "digest")} | dict.fromkeys(COUNTS, 0)
                own |= {"symbols": [], "first": initial, "last": None, "low": turn, "high": turn, "turns": 0, "seen": None}
            repeated = not row["blank"] and (copy > 0 or not row["earliest"])
            truncated = not row["blank"] and not repeated and row["cut"]
            own["blank"] += row["blank"]
            own["duplicate"] += repeated
            own["truncated"] += truncated
            own["illegal"] += own["last"] is not None and own["last"] + initial not in LEGAL
            own["last"] = initial
            own["symbols"].append(symbol(initial, row["blank"] or repeated, truncated))
            if turn is not None:
                own["turns"] += turn != own["seen"]
                own["low"], own["high"] = turn if own["low"] is None else own["low"], turn
                own["seen"] = turn
    if own is not None:
        yield done()


def _folded(rows: Iterator[dict], grammar: Grammar) -> Iterator[tuple]:
    """Segments, all of a conversation in order: the states between which each is repaired, with the last the conversation's figures."""
    whole: Matrix | None = None
    totals: dict = {}
    middles: list[bytes] = []
    places: list[tuple[int, int]] = []

    def done() -> Iterator[tuple]:
        cost, q = ending(whole)
        gaps = 0 if totals["low"] is None else totals["high"] - totals["low"] + 1 - totals["turns"]
        found = []
        for k in range(len(places) - 1, -1, -1):
            p = middles[k][q] if k else START
            figures = (gaps, *(totals[c] for c in COUNTS), cost) if k == len(places) - 1 else (None,) * 6
            found.append((*places[k], p, q, *figures))
            q = p
        yield from reversed(found)

    for row in rows:
        matrix = grammar.prefixes(row["symbols"])[1][-1]
        if whole is None or totals["conv_id"] != row["conv_id"]:
            if whole is not None:
                yield from done()
            whole, totals, middles, places = matrix, dict(row), [b""], []
        else:
            whole = whole.then(matrix)
            middles.append(bytes(whole.middle[:4]))  # from the start only
            for c in COUNTS:
                totals[c] += row[c]
            totals["illegal"] += totals["last"] + row["first"] not in LEGAL
            # rows of one turn that were cut apart count once
            totals["turns"] += row["turns"] - (row["low"] is not None and row["low"] == totals["high"])
            totals["low"] = row["low"] if totals["low"] is None else totals["low"]
            totals["high"] = totals["high"] if row["high"] is None else row["high"]
            totals["last"] = row["last"]
        places.append((row["part"], row["at"]))
    if whole is not None:
        yield from done()


class Repair:
    """Applies edits to the rows of a conversation as they pass by."""

    def __init__(self):
        self.state, self.digest, self.any, self.audit, self.todo = START, hashlib.sha256(), False, [], iter(())
        self.waiting: list[str] = []
        self.figures: tuple = ()

    def add(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
        self.any = True

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state, role = _next(self.state)
            self.add(role, "")

    def edit(self, audit: str) -> None:
        """Edits of further rows."""
        self.audit.append(audit)
        self.waiting.append(audit)

    def _token(self) -> str:
        for token in self.todo:
            return token[0]
        self.todo = re.finditer("I*[KRD]", self.waiting.pop(0))
        return self._token()

    def row(self, role: str, text: str) -> None:
        token = self._token()
        self.insert(len(token) - 1)
        if token[-1] == "R":
            self.state, role = _next(self.state)
        elif token[-1] == "K":
            self.state = MOVES[role[:1], self.state]
        if token[-1] != "D":
            self.add(role, text)

    def finish(self) -> tuple[str, str]:
        end = "I" * ENDING[self.state]
        self.insert(len(end))
        return "".join(self.audit) + end, self.digest.hexdigest()


def _repaired(rows: Iterator[dict]) -> Iterator[tuple]:
    """Segments and rows of whole conversations, every segment before its rows."""
    own, conv_id = None, None
    for row in rows:
        if own is None or row["conv_id"] != conv_id:
            if own is not None:
                yield (conv_id, *own.figures, *own.finish())
            own, conv_id = Repair(), row["conv_id"]
        if row["audit"] is not None:
            own.edit(row["audit"])
            if row["cost"] is not None:
                own.figures = tuple(row[c] for c in ("gaps", *COUNTS, "cost"))
        else:
            own.row(row["role"], row["text"])
    if own is not None:
        yield (conv_id, *own.figures, *own.finish())


def _mapped(df: DataFrame, work, schema: str, *extra) -> DataFrame:
    """``work`` over the rows of every partition, in their order."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    return df.mapInArrow(lambda batches: _tabled(work(_rows(batches), *extra), arrow), struct)


def _pairs(rows: Iterator[dict], grammar: Grammar) -> Iterator[tuple]:
    """Pairs of neighbouring symbols after the rules so far, with the number of segments they occur in."""
    counts: Counter = Counter()
    for row in rows:
        packed = grammar.compressed(row["symbols"])
        for pair, n in Counter(map("".join, zip(packed, packed[1:]))).items():
            counts[pair] += n * row["n"]
    yield from counts.items()


def paired_rules(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[tuple[str, str, str]]:
    """Re-Pair rules from distinct sequences (symbols, n): in each round the most frequent pairs; at most rounds x rules in all."""
    found: list[tuple[str, str, str]] = []
    for _ in range(rounds):
        counted = _mapped(sequences, _pairs, "pair string, n bigint", Grammar(found)).groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        if not best:
            break
        found += [(r.pair[0], r.pair[1], chr(0x100 + len(found) + k)) for k, r in enumerate(best)]
    return found


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls in any column are one space; ids and turns stay null).

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it the user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), n.alias("_n")).filter("_n <> 0")
    role = F.when(F.col("_n") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_n") == 1, "").when(F.col("_n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _same(left: str, right: str, *names: str) -> Column:
    matched = F.lit(True)
    for name in names:
        matched &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return matched


FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def repair_conversations(turns: DataFrame, conversations: DataFrame | None = None, segment: int = SEGMENT, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """Cheapest repair of every conversation of ``turns`` (conv_id, turn, role, text) to the roles ``(system? (user assistant)+)?``.

    One row for each conv_id of ``conversations`` (default: those of ``turns``): conv_id, gaps (missing turns between the first
    and the last), blank, duplicate, truncated (first faults of rows), illegal (neighbours whose role initials are not su, ua or au), cost,
    audit (initials of the edits Keep, Rerole, Delete and Insert in order; of the cheapest the least in ASCII) and repaired_sha256 (of the
    repaired ``role:text`` rows joined by line feeds). Rows stand by turn, nulls first, those of one turn by role and digest of the
    text. A null role or text is one space; null ids are one conversation; roles other than system, user and assistant count by
    their initial. A conversation without rows has zeros, no edits and the digest of the empty string. Other columns are left out.
    """
    clean = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    ids = (clean if conversations is None else conversations).select("conv_id").distinct()
    kind = dict(clean.dtypes)["conv_id"]
    trimmed = F.rtrim("text", F.lit(SPACES))
    marked = clean.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    rows = marked.groupBy(order).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    first = first.select("conv_id", "role", "digest", F.col("first.turn").alias("turn"), F.lit(True).alias("earliest"))
    told = rows.alias("r").join(first.alias("f"), _same("r", "f", *order), "left")  # on the turn too, so no text is one hot key
    told = told.select("r.*", F.coalesce("f.earliest", F.lit(False)).alias("earliest"))
    ordered = told.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"conv_id {kind}, turn bigint, role string, digest binary, part bigint, at bigint, symbols string, first string, last string, "
    schema += "blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint"
    segments = written(_mapped(ordered, _segments, schema, segment), "segments")

    sequences = written(segments.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    grammar = Grammar(paired_rules(sequences, rounds, rules))  # bounded: rounds x rules
    shown = segments.select("conv_id", "part", "at", "symbols", "first", "last", *COUNTS, "low", "high", "turns")
    shown = shown.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    states = _mapped(shown, _folded, f"part bigint, at bigint, p int, q int, {FIGURES}", grammar)
    solved = segments.alias("s").join(states.alias("t"), ["part", "at"]).select(
        "s.conv_id", "s.turn", "s.role", "s.digest", "at", "s.symbols", "t.p", "t.q", "t.gaps", *(f"t.{c}" for c in (*COUNTS, "cost"))
    )

    def audited(found: Iterator[dict]) -> Iterator[tuple]:
        for r in found:
            yield (r["conv_id"], r["turn"], r["role"], r["digest"], r["at"], grammar.audit(r["symbols"], r["p"], r["q"]), *(r[c] for c in ("gaps", *COUNTS, "cost")))

    edited = _mapped(solved, audited, f"conv_id {kind}, turn bigint, role string, digest binary, at bigint, audit string, {FIGURES}")
    texts = clean.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(trimmed == "", "").otherwise(F.col("text")).alias("text"))
    stream = edited.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    stream = stream.sortWithinPartitions(*order, F.col("at").asc_nulls_last()).select("conv_id", "role", "text", "audit", "gaps", *COUNTS, "cost")
    repaired = _mapped(stream, _repaired, f"conv_id {kind}, {FIGURES}, audit string, repaired_sha256 string")
    return ids.alias("i").join(repaired.alias("r"), _same("i", "r", "conv_id"), "left").select(
        "i.conv_id", *(F.coalesce(f"r.{c}", F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *COUNTS, "cost")),
        F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
