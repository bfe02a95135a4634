"""Near-dedup of texts by SetSketch registers.

Every set of word shingles is sketched into registers, each the exponentially spaced, truncated minimum of a hash over
the set. Registers of a union are the larger ones, and equal sets of registers are likely for similar
sets. Bands of registers bring candidates together; the counts of larger, smaller and equal registers give the
joint likelihood of the similarity; what may reach the threshold is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

#: Base of the register values; neighbouring values stand for minima that differ by this factor.
BASE = 1.1

#: Register value of a minimum of 1; smaller sets stay clear of 0, sets of up to 10^8 shingles of 255.
ZERO = 40

#: Registers of a band and number of bands: a pair at similarity 0.8 shares no band with probability 3e-4.
BAND, BANDS = 7, 32

#: A pair is dropped unverified if the likelihood ratio against the threshold is 5 standard deviations.
DEVIATIONS = 5.0

#: Buckets of up to this many sets are compared pair by pair, larger ones by stars and then across components.
SMALL_BUCKET = 8

#: Sets of a block in the comparison across components, on average.
BLOCK_SETS = 256

#: Bytes of text that are worked at a time.
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SCALE = _random.integers(1, 2**63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, BAND * BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of every text.

    A-Z count as a-z, words are runs of bytes other than ASCII white space. A text of fewer words is one shingle, a
    text without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    first = np.searchsorted(at, starts)  # where each word begins among the bytes of words
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(lengths.max() - 1, _POWER))))
    word = _mix(np.add.reduceat(_BYTE[data[at]] * powers[within], first) + lengths.astype(np.uint64))
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(starts, limits)
    sets = []
    for a, b in zip(of, of[1:]):
        run, size = word[a:b], min(words, b - a)
        if not size:
            sets.append(np.empty(0, np.uint64))
            continue
        value = np.full(b - a - size + 1, np.uint64(size))
        for k in range(size):
            value = _mix(value * _POWER + run[k : len(run) - size + 1 + k])
        sets.append(np.unique(value))
    return sets


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a set that is not empty: one byte a register."""
    least = np.full(len(_SCALE), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        part = hashes[None, start : start + 1024] * _SCALE[:, None]
        part += _SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    spaced = np.floor(ZERO - np.log(-np.log1p(-np.minimum(uniform, 1 - 1e-16))) / log(BASE))
    return np.clip(spaced, 0, 255).astype(np.uint8)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, a slice of bounded bytes (or one text) at a time; null counts as empty."""
    held, texts, start = 0, [], 0
    for k, value in enumerate(batch.column("text").cast(pa.binary())):
        texts.append(value.as_py() or b"")
        held += len(texts[-1])
        if held >= SLICE_BYTES:
            yield start, texts
            held, texts, start = 0, [], k + 1
    if texts:
        yield start, texts


def _sketched(batches: Iterator[pa.RecordBatch], words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in _slices(batch):
            sets = shingle_sets(texts, words)
            low = [int(_mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            high = [int(_mix(s ^ np.uint64(0x5A5A0000)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            last = [s.tobytes() if whole else registers(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(last, pa.binary())],
                names=["doc_id", "n_shingles", "low", "high", "held"],
            )


def sketch(docs: DataFrame, words: int = 2, whole: bool = False) -> DataFrame:
    """(doc_id, n_shingles, low, high, held): low and high name the set in 128 bits, held are its registers or, with
    ``whole``, all its hashes in order."""
    schema = "doc_id bigint, n_shingles bigint, low bigint, high bigint, held binary"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _sketched(batches, words, whole), schema)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, fewer: np.ndarray, equal: np.ndarray) -> np.ndarray:
    chance = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / log(BASE), 1e-12, 1)
    up, down = chance(u - v * j), chance(v - u * j)
    return more * np.log(up) + fewer * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def may_reach(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the similarity of sets with sizes n and registers a, b is compatible with the threshold."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    counts = [x.sum(axis=1)[:, None] for x in (a > b, a < b, a == b)]
    most = np.minimum(u / v, v / u)
    best = lambda low, steps: _log_likelihood(low + (most - low) * np.linspace(0, 1, steps), u, v, *counts).max(axis=1)
    free, bound = best(np.zeros_like(most), 101), best(np.minimum(threshold, most), 21)
    return (most[:, 0] >= threshold - 1e-12) & (2 * (free - bound) <= DEVIATIONS**2)


def _estimated(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def likely(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        rows = [np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b)]
        out = [may_reach(n_a.to_numpy(float)[i : i + 2048], n_b.to_numpy(float)[i : i + 2048], rows[0][i : i + 2048], rows[1][i : i + 2048], threshold)
               for i in range(0, len(a), 2048)]
        return pd.Series(np.concatenate(out))

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("held").alias(f"r_{side}")), side)
    return pairs.filter(likely("n_a", "n_b", "r_a", "r_b")).select("a", "b")


def _full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(rep, held) with all hashes of the sets of ``ids`` (rep, low, high).

    The texts are joined by sort-merge whatever the number of ids, so that the plan is the same at every size.
    """
    texts = docs.join(ids.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    return sketch(texts, words, whole=True).join(ids.withColumnRenamed("rep", "doc_id"), ["doc_id", "low", "high"]).select(F.col("doc_id").alias("rep"), "held")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs, by intersection and union of the full sets."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        def reaches(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return pd.Series([reaches(x, y) for x, y in zip(a, b)], dtype=bool)

    for side in "ab":
        pairs = pairs.join(full.select(F.col("rep").alias(side), F.col("held").alias(f"s_{side}")), side)
    return pairs.filter(linked("s_a", "s_b")).select("a", "b")


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the outside sets of a block and its other sets, one for each component that an outside set reaches."""
    outside = np.asarray(rows.column("outside").combine_chunks().to_numpy(zero_copy_only=False))
    rep, own = rows.column("rep").to_numpy(), rows.column("own").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("held")]
    sizes = np.array([len(x) for x in sets], np.float64)
    x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
    both = np.zeros((len(x), len(y)))
    if len(x) and len(y):
        shared = np.unique(np.concatenate([sets[i] for i in x]))
        for start in range(0, len(shared), 4096):  # intersections as products of incidence matrices
            some = shared[start : start + 4096]
            hold = [np.zeros((len(side), len(some)), np.float32) for side in (x, y)]
            for matrix, side in zip(hold, (x, y)):
                for k, i in enumerate(side):
                    at = np.minimum(np.searchsorted(some, sets[i]), len(some) - 1)
                    matrix[k, at[some[at] == sets[i]]] = 1
            both += hold[0] @ hold[1].T
    linked = 100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)
    u, v = np.nonzero(linked & (own[x][:, None] != own[y][None, :]))
    _, first = np.unique(np.stack([u, own[y[v]]]), axis=1, return_index=True)
    u, v = u[first], v[first]
    return pa.table({"a": pa.array(rep[x[u]], pa.int64()), "b": pa.array(rep[y[v]], pa.int64())})


def _across(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links of the sets that share a bucket with a large component but lie outside of it, with all the sets there.

    ``placed`` (main, rep, n, own) holds the sets of buckets whose largest component is ``main``. Outside sets and all sets are
    dealt to blocks of bounded size, and a block of the one is compared with a block of the other in one task.
    """
    block = lambda count: F.greatest(F.ceil(count / F.lit(BLOCK_SETS)), F.lit(1)).cast("int")
    counts = placed.groupBy("main").agg(block(F.count(F.lit(1))).alias("all_blocks"), block(F.count_if(F.col("own") != F.col("main"))).alias("outside_blocks"))
    rows = placed.join(counts, "main").join(full, "rep")
    dealt = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    outside = rows.filter("own <> main").select("main", dealt("outside_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("outside"), "rep", "own", "held")
    others = rows.select("main", every("outside_blocks").alias("i"), dealt("all_blocks").alias("j"), F.lit(False).alias("outside"), "rep", "own", "held")
    return outside.union(others).groupBy("main", "i", "j").applyInArrow(lambda rows: _block_links(rows, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose shingle sets are linked: (doc_id, n_shingles, component_id, kept).

    Two documents are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id that links
    lead to, kept marks it. Null, empty and blank texts have no shingles and stand alone. Rows without doc_id get their
    n_shingles and null for the rest. Rows repeated under one id are one node and are all returned; other columns are
    left out; an empty table gives none.

    Equal sets are one node from the start, so exact copies never meet. Buckets of a band are compared by pairs if
    they are small. The members of a larger one are compared with one of them, drawn by hash; if a bucket then holds several
    components, the sets outside its largest one are compared with all that share a bucket with it, in blocks that
    pass on only links. So a large group of copies costs a few pairs a member, and no link between sets that
    share a band is lost. No bucket or set of candidates is capped.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = written(sketch(docs, words), "sketches")
    name = ["n_shingles", "low", "high"]
    filled = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = written(filled.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.any_value("held").alias("held")), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("held", 1 + i * BAND, BAND)) for i in range(BANDS)])
    bands = sets.select("rep", F.col("n_shingles").alias("n"), F.explode(keys).alias("key"))
    drawn = F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "key"))
    buckets = bands.groupBy("key").agg(drawn.alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(bands.join(buckets, "key"), "buckets")
    small, large = shared.filter(F.col("size") <= SMALL_BUCKET), shared.filter(F.col("size") > SMALL_BUCKET)

    def sized(x: str, y: str):
        return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (x, n_x, y, n_y), each once, whose sizes and registers allow a link."""
        pairs = pairs.filter("x <> y").filter(sized("n_x", "n_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return written(_estimated(pairs.distinct(), sets, percent / 100), "pairs")

    left, right = (small.select("key", F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in "xy")
    stars = large.select(F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("centre.rep").alias("y"), F.col("centre.n").alias("n_y"))
    tested = likely(left.join(right, "key").filter("x < y").drop("key").unionByName(stars))
    ids = tested.select(F.col("a").alias("rep")).union(tested.select("b")).union(large.select("rep")).distinct()
    full = written(_full_sets(written(ids.join(sets.select("rep", "low", "high"), "rep"), "candidates"), docs, words), "sets")
    links = written(_verified(tested, full, percent), "links")
    groups = components(links)

    placed = large.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("own"))
    parts = placed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("members")).groupBy("key").agg(
        F.max_by("own", F.struct("members", "own")).alias("main"), F.count(F.lit(1)).alias("parts")
    )
    placed = written(placed.join(parts.filter("parts > 1"), "key").select("main", "rep", "n", "own").distinct(), "placed")
    more = written(_across(placed, full, percent), "links")
    if not more.isEmpty():
        groups = components(links.union(more))

    nodes = sets.select(*name, "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select(*name, F.coalesce("component", "rep").alias("component_id"))
    found = sketches.select("doc_id", *name).join(nodes, name, "left")
    # an id that stands for several texts belongs to one component, whichever of them leads there
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, with the columns of ``docs``; rows without doc_id stay."""
    dropped = written(near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"] == F.col("dropped"), "left_anti")
