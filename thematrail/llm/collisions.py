"""Embedding near-dedup by collision counting on many one-dimensional projections.

Every vector is projected onto many random directions and entered in the lists of those on which it lies farthest out: there
the lists are thin, and a similar vector most likely lies beside it. Lists are sorted by projection, two
vectors collide in a list if one lies in the window centred at the other, and pairs with as many collisions as
the recall calls for are verified by their cosine. The number of collisions is calibrated by simulating pairs that just
reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

#: Lists that a vector enters; half the width of a window in standard normal projections.
ENTRIES, WINDOW = 12, 1.0

#: Share of the pairs at the threshold that must have as many collisions as are asked for.
RECALL = 0.995

#: Vectors of one list that are compared in one block; longer lists are cut into parts compared two by two.
PART = 1024

#: Vectors for which ``MIN_PROJECTIONS`` are used; twice the vectors get twice the projections.
#: Beyond the most, lists grow with the table and are cut into more parts.
BASE_VECTORS, MIN_PROJECTIONS, MAX_PROJECTIONS = 1_000_000, 1024, 1 << 18

#: Directions that are projected on at once.
DIRECTIONS = 1024


@lru_cache(maxsize=8)
def _directions(dim: int, block: int) -> np.ndarray:
    """One block of directions, drawn anew where it is needed."""
    return np.random.default_rng([dim, DIRECTIONS + block]).normal(size=(dim, DIRECTIONS))


def outermost(vectors: np.ndarray, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists (two for a direction, one for each sign) in which each unit vector lies farthest out, and where.

    Directions come in blocks, of which only the outermost so far are held, so the memory needed does not grow with
    their number.
    """
    lists, value = np.empty((len(vectors), 0), np.int64), np.empty((len(vectors), 0))
    for block in range(-(-projections // DIRECTIONS)):
        start = block * DIRECTIONS
        at = vectors @ _directions(vectors.shape[1], block)[:, : projections - start]
        chosen = np.argpartition(-np.abs(at), min(ENTRIES, at.shape[1]) - 1, axis=1)[:, :ENTRIES]
        lists = np.concatenate([lists, chosen + start], axis=1)
        value = np.concatenate([value, np.take_along_axis(at, chosen, 1)], axis=1)
        if lists.shape[1] > ENTRIES:
            best = np.argpartition(-np.abs(value), ENTRIES - 1, axis=1)[:, :ENTRIES]
            lists, value = np.take_along_axis(lists, best, 1), np.take_along_axis(value, best, 1)
    return (lists * 2 + (value < 0)).astype(np.int32), np.abs(value).astype(np.float32)


def collisions(lists_a: np.ndarray, at_a: np.ndarray, lists_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows in which the vectors of each row of a and b meet, and the first list of these."""
    count = np.zeros(len(lists_a), np.int32)
    first = np.full(len(lists_a), np.iinfo(np.int32).max)
    for k in range(lists_b.shape[1]):
        meet = (lists_a == lists_b[:, k : k + 1]) & (np.abs(at_a - at_b[:, k : k + 1]) <= WINDOW)
        count += meet.sum(axis=1, dtype=np.int32)
        first = np.where(meet.any(axis=1), np.minimum(first, lists_b[:, k]), first)
    return count, first


@lru_cache(maxsize=64)
def calibrated_count(dim: int, projections: int, cosine: float, pairs: int = 2000) -> int:
    """The largest count of collisions that ``RECALL`` of simulated pairs at the threshold reach, at least 1."""
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(axis=1)[:, None] * a
    length = np.linalg.norm(b, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.where(length > 0, length, 1)
    count, _ = collisions(*outermost(a, projections), *outermost(b, projections))
    return max(1, int(np.quantile(count, 1 - RECALL, method="lower")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.float64).reshape(-1, dim)


def _entered(batches: Iterator[pa.RecordBatch], projections: int) -> Iterator[pa.RecordBatch]:
    """One row for each list that a vector enters, with all its lists and its unit vector."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            chosen = batch.filter(pa.array(dims == dim))
            for start in range(0, chosen.num_rows, 1024):
                part = chosen.slice(start, 1024)
                vectors = np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, dim)
                vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # no overflow of squares
                vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
                lists, at = outermost(vectors, projections)
                n, width = lists.shape
                repeat = pa.array(np.repeat(np.arange(n), width))
                taken = lambda name: part.column(name).take(repeat)
                packed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary()).take(repeat)
                yield pa.RecordBatch.from_arrays(
                    [taken("label"), taken("dim"), pa.array(lists.ravel()), taken("rep"), taken("copies"), packed(lists), packed(at), packed(vectors)],
                    names=["label", "dim", "list", "rep", "copies", "lists", "at", "unit"],
                )


def _block(rows: pa.Table, projections: int, cosine: float) -> pa.RecordBatch:
    """Links within one block of a list: how many each vector has and the smallest vector it is linked to here."""
    dim, here = rows.column("dim")[0].as_py(), rows.column("list")[0].as_py()
    one, two = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    rows = rows.combine_chunks()
    part = np.asarray(rows.column("part"))
    rep, copies = np.asarray(rows.column("rep")), np.asarray(rows.column("copies"))
    flat = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind).reshape(len(rep), -1)
    lists, at, unit = flat("lists", np.int32), flat("at", np.float32), flat("unit", np.float64)
    position = at[lists == here]
    n = len(rep)
    links, root = np.zeros(n, np.int64), np.arange(n)
    least = calibrated_count(dim, projections, cosine)
    order = np.argsort(position, kind="stable")  # the sorted list; windows are stretches of it
    ends = np.searchsorted(position[order], position[order] + np.float32(WINDOW), side="right")
    pairs = []
    for start in range(0, n, 128):
        stop = min(start + 128, n)
        reach = int(ends[stop - 1])
        u, v = np.nonzero(np.arange(start, reach)[None, :] > np.arange(start, stop)[:, None])
        u, v = order[u + start], order[v + start]
        if one != two:
            u, v = (x[part[u] != part[v]] for x in (u, v))
        for k in range(0, len(u), 16384):
            a, b = u[k : k + 16384], v[k : k + 16384]
            count, first = collisions(lists[a], at[a], lists[b], at[b])
            passed = (count >= least) & (first == here)
            a, b = a[passed], b[passed]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            pairs.append((a[near], b[near]))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        label = rep.copy()
        while len(a):
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        root = label
    else:
        root = rep
    found = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[found]), pa.array(links[found]), pa.array(root[found])], names=["rep", "links", "root"])


def _compared(batches: Iterator[pa.RecordBatch], projections: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Blocks lie one after another in the rows; only one is held."""
    held: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        names = [np.asarray(batch.column(c)) for c in ("label", "dim", "list", "i", "j")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1 if batch.num_rows else np.empty(0, int)
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            if start == stop:
                continue
            own = tuple(x[start] for x in names)
            if own != block and held:
                yield _block(pa.Table.from_batches(held), projections, cosine)
                held = []
            block = own
            held.append(batch.slice(start, stop - start))
    if held:
        yield _block(pa.Table.from_batches(held), projections, cosine)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", projections: int | None = None) -> DataFrame:
    """Groups of vectors of one label that are linked: (vec_id, n_links, component_id, kept).

    Vectors are linked if their labels are equal and their cosine in double precision is at least ``cosine``; pairs
    below are never linked, of those at the threshold ``RECALL`` are found and of closer ones more. Vectors that are null,
    empty, zero or hold null or non-finite components, and those with a null label, are linked with nothing; vectors
    of different lengths are not compared. Rows without vec_id are returned with 0 links and null for the rest. Repeated
    rows count as vectors of their own. Other columns are left out; an empty table gives none.

    Equal vectors are one vector with a number of copies from the start. A long list is cut into parts, each pair of parts one
    block of bounded size, so no list is ever one task. Blocks pass on how many links each vector has and one
    link to the smallest vector it is joined with, never the pairs; a pair counts in the first list where it collides.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("bigint").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    kinds = written(
        rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")),
        "vectors",
    )
    if projections is None:
        wanted = MIN_PROJECTIONS * kinds.count() / BASE_VECTORS
        projections = int(min(MAX_PROJECTIONS, max(MIN_PROJECTIONS, 2 ** np.ceil(np.log2(max(wanted, 1))))))
    entry = "label bigint, dim int, list int, rep bigint, copies bigint, lists binary, at binary, unit binary"
    entries = kinds.mapInArrow(lambda batches: _entered(batches, projections), entry)
    place = ["label", "dim", "list"]
    long_lists = written(entries.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts")).filter("parts > 1"), "lists")
    parts = F.coalesce("parts", F.lit(1))
    dealt = entries.join(long_lists, place, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("*", other.alias("other")).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    blocks = dealt.select(*place, "i", "j", "part", "rep", "copies", "lists", "at", "unit").repartition(*place, "i", "j").sortWithinPartitions(*place, "i", "j")
    found = written(blocks.mapInArrow(lambda batches: _compared(batches, projections, cosine), "rep bigint, links bigint, root bigint"), "found")
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = kinds.join(links, "rep", "left").join(groups, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = rows.join(nodes, ["label", "embedding"], "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
