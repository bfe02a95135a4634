"""Exact nearest pages from an index of cells: whatever the triangle inequality rules out is not read.

Every page goes to the nearest of a bounded number of centres. The pages of a cell are sorted by their distance to its centre
and cut into blocks of bounded size, each a ring between two radii. A page at radius r of a centre that is d away from a question is
at least ``|d - r|`` away from it, so a block whose whole ring is farther than the k-th page found so far cannot hold a hit. No recall is lost.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import write_report
from .retrieval import DISTANCE_DIGITS, _keys, _matrix, _Nearest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Centres at most; fewer (the square root of the number of pages) for small tables.
MAX_CELLS = 1024

#: Pages in a block, unless the table is so large that there would be more than MAX_BLOCKS.
BLOCK_PAGES = 2048

#: Blocks that the plan of a search knows at most, but for one more a cell and a task of the build (28 bytes each).
MAX_BLOCKS = 1 << 20

#: Blocks that one task of the build writes.
BLOCKS_A_TASK = 64

#: Questions that are compared with a block in one group, on average.
QUESTIONS = 1024

#: Room for rounding in bounds, as a part of the numbers they are made of.
SLACK = 1e-9


@dataclass
class CellIndex:
    """Pages in blocks, the ring of every block, and the centres, in a folder."""

    folder: str
    pages: DataFrame  # cell, block, radius, page_id, embedding, page (all other columns)
    blocks: DataFrame  # block, cell, low, high, n
    centres: np.ndarray

    def plan(self) -> tuple[np.ndarray, ...]:
        """Centres, and of every block its number, cell, smallest and largest radius and pages; bounded by MAX_CELLS and MAX_BLOCKS."""
        table = self.blocks.orderBy("block").toArrow()
        return (self.centres, *(table.column(name).to_numpy() for name in ("block", "cell", "low", "high", "n")))


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter((F.size("embedding") == dims) & finite)


def build_cells(pages: DataFrame, folder: str, max_cells: int = MAX_CELLS, block_pages: int = BLOCK_PAGES) -> CellIndex:
    """Write the index of ``pages`` (page_id, embedding, ...) to a folder that all executors share.

    The length most vectors have (the longer one of equals) is the index's. Vectors of another length, null, or with null or non-finite components, and
    pages without an id, are not indexed and so are never hits; repeated pages are kept. Centres are the pages whose ids hash lowest. Copies of a vector
    fill as many blocks as they need, in the order of their ids: no cell or group of copies is ever one task.
    """
    spark = pages.sparkSession
    held = pages.filter("page_id IS NOT NULL").withColumn("page_id", F.col("page_id").cast("bigint"))
    lengths = held.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    held = _usable(held, common["dims"] if common else 0)
    n_pages = held.count()
    cells = int(min(max_cells, np.ceil(np.sqrt(max(n_pages, 1)))))
    centres = _matrix(held.select("page_id", "embedding").orderBy(F.xxhash64("page_id"), "page_id", "embedding").limit(cells).toArrow()) if n_pages else np.zeros((1, 0))
    per_block = max(block_pages, -(-n_pages // MAX_BLOCKS))
    shared = spark.sparkContext.broadcast(centres)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles = shared.value
        squares = (middles * middles).sum(axis=1)
        for batch in batches:
            vectors = _matrix(pa.Table.from_batches([batch]))
            cell = np.empty(len(vectors), np.int32)
            for start in range(0, len(vectors), 4096):  # the product is at most 4096 x MAX_CELLS numbers
                part = slice(start, start + 4096)
                cell[part] = (squares - 2.0 * (vectors[part] @ middles.T)).argmin(axis=1)
            radius = np.sqrt(((vectors - middles[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held_cell, filled = (TaskContext.get().partitionId() << 24) - 1, None, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for at, cell in enumerate(batch.column("cell").to_numpy()):
                if cell != held_cell or filled == per_block:
                    block, held_cell, filled = block + 1, cell, 0
                numbers[at] = block
                filled += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "block"])

    held = held.select(F.struct(*[F.col(f"`{c}`") for c in held.columns if c != "embedding"]).alias("page"), "page_id", "embedding")
    carried = ", ".join(f"`{name}` {kind}" for name, kind in held.dtypes) + ", cell int, radius double"
    # written, so that the range sort samples it without working it out twice and a rerun task finds the same rows
    write_report(held.mapInArrow(assigned, carried), f"{folder}/placed")
    placed = spark.read.schema(carried).parquet(f"{folder}/placed")
    tasks = max(1, -(-n_pages // (per_block * BLOCKS_A_TASK)))
    order = ["cell", "radius", "page_id"]
    dealt = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    numbered = dealt.mapInArrow(cut, f"{carried}, block bigint")
    numbered.write.partitionBy("cell").parquet(f"{folder}/pages")
    stored = spark.read.schema(numbered.schema).parquet(f"{folder}/pages")
    rings = stored.groupBy("block").agg(
        F.first("cell").alias("cell"), F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n")
    )
    write_report(rings, f"{folder}/blocks")
    return CellIndex(folder, stored, spark.read.parquet(f"{folder}/blocks"), centres)


def _bounds(plan: tuple[np.ndarray, ...], question: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every block: the least distance a page in it can have, and a guess at the distance most have."""
    centres, _, cell, low, high, _ = plan
    away = np.sqrt(((centres - question) ** 2).sum(axis=1))[cell]
    least = np.maximum(np.maximum(away - high, low - away) - SLACK * (away + high), 0)
    return least, away**2 + ((low + high) / 2) ** 2


def cell_search(index: CellIndex, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k pages nearest to each query, as :func:`..retrieval.knn` gives them: ``query_id, page_id, distance, rank``.

    ``queries`` holds (query_id, embedding), any number of them; those whose vector is null, not finite or of another length find nothing. ``where``
    filters the pages first and may use any of their columns but the vector. A query first reads the blocks that most likely hold its nearest
    pages, k pages or more; the k-th of them is its reach, and it then reads every other block that has a page within
    it. Only questions move to blocks and only k rows a query and block come back.
    """
    first, rest = _read(index, queries, k, where)
    near = first.unionByName(rest)
    place = Window.partitionBy("query_id").orderBy("distance", "page_id")
    hits = near.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return hits.select("query_id", "page_id", F.round("distance", DISTANCE_DIGITS).alias("distance"), "rank")


def share_read(index: CellIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """How many pages each query is compared with: ``query_id, pages_read, pages``."""
    folder = _searched(index, queries, k, None)[0]
    spark = queries.sparkSession
    pairs = spark.read.parquet(f"{folder}/first").select("query_id", F.explode("blocks").alias("block"))
    pairs = pairs.unionByName(spark.read.parquet(f"{folder}/rest").select("query_id", F.explode("blocks").alias("block")))
    read = pairs.join(index.blocks.select("block", "n"), "block").groupBy("query_id").agg(F.sum("n").alias("pages_read"))
    return read.select("query_id", "pages_read", index.blocks.agg(F.sum("n")).scalar().alias("pages"))


def _read(index: CellIndex, queries: DataFrame, k: int, where: Column | None) -> tuple[DataFrame, DataFrame]:
    folder, ddl = _searched(index, queries, k, where)
    spark = queries.sparkSession
    return spark.read.schema(ddl).parquet(f"{folder}/near"), _compared(index, spark.read.parquet(f"{folder}/rest"), k, where)


def _searched(index: CellIndex, queries: DataFrame, k: int, where: Column | None) -> tuple[str, str]:
    """Write what each query reads first, the hits found there, and what it has to read besides."""
    spark = queries.sparkSession
    folder = f"{index.folder}/search-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(index.plan())
    kind = dict(queries.dtypes)["query_id"]
    ddl = f"query_id {kind}, embedding array<double>, blocks array<bigint>"
    asked = _usable(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), index.centres.shape[1])
    asked = asked.filter("query_id IS NOT NULL")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            chosen = []
            for question in _matrix(pa.Table.from_batches([batch])):
                order = np.argsort(_bounds(plan, question)[1], kind="stable")
                enough = np.searchsorted(np.cumsum(plan[5][order]), k) + 1
                chosen.append(plan[1][order[:enough]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int64()))], names=["query_id", "embedding", "blocks"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            left = []
            for question, done, reach in zip(_matrix(pa.Table.from_batches([batch])), batch.column("blocks").to_pylist(), batch.column("reach").to_numpy(zero_copy_only=False)):
                least = _bounds(plan, question)[0]
                near = plan[1][least <= np.sqrt(reach) * (1 + SLACK)]
                left.append(np.setdiff1d(near, done))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("embedding"), pa.array(left, pa.list_(pa.int64()))], names=["query_id", "embedding", "blocks"]
            )

    write_report(asked.mapInArrow(likely, ddl), f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    near = _compared(index, first, k, where)
    write_report(near, f"{folder}/near")
    near = spark.read.schema(near.schema).parquet(f"{folder}/near")
    place = Window.partitionBy("query_id").orderBy("distance", "page_id")
    reach = near.withColumn("place", F.row_number().over(place)).filter(F.col("place") == k).select(F.col("query_id").alias("of"), F.col("distance").alias("reach"))
    known = first.join(reach, F.col("query_id") == F.col("of"), "left").select(
        "query_id", "embedding", "blocks", F.coalesce("reach", F.lit(float("inf"))).alias("reach")
    )
    write_report(known.mapInArrow(within, ddl), f"{folder}/rest")
    return folder, f"query_id {kind}, page_id bigint, distance double"


def _compared(index: CellIndex, wanted: DataFrame, k: int, where: Column | None) -> DataFrame:
    """The k nearest pages of every wanted (query, block): ``query_id, page_id, distance``.

    A block that many queries want is compared with them in parts, so that no group holds more than a block and about QUESTIONS questions.
    """
    pairs = wanted.select("query_id", "embedding", F.explode("blocks").alias("block"))
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts"))
    asked = pairs.join(parts, "block").select("query_id", "embedding", "block", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"))
    # At most MAX_CELLS numbers: the folders of all other cells are not opened.
    cells = [row["cell"] for row in index.blocks.join(parts, "block", "left_semi").select("cell").distinct().collect()]
    pages = index.pages.filter(F.col("cell").isin(cells))
    if where is not None:
        kept = pages.select(F.struct("block", "embedding").alias("block and vector"), "page.*").filter(F.coalesce(where, F.lit(False)))
        pages = kept.select("`block and vector`.*", "page_id")
    blocks = pages.select("block", "page_id", "embedding").join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "page_id", "embedding", F.lit(True).alias("wanted")
    )

    def compare(questions: pa.Table, pages: pa.Table) -> pa.Table:
        if questions.num_rows == 0 or pages.num_rows == 0:
            return _Nearest(np.empty((0, 0)), k).rows(_keys(questions)).drop_columns(["wanted"])
        best = _Nearest(_matrix(questions), k)
        best.add(pages)
        return best.rows(_keys(questions)).drop_columns(["wanted"])

    kind = dict(wanted.dtypes)["query_id"]
    keys = ["block", "part"]
    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(compare, f"query_id {kind}, page_id bigint, distance double")
