"""Sentences ranked by their graph: two sentences of a category are linked by the weights of the words they share.

The ranking is the leading eigenvector of that graph, found by power iteration. No link is ever a row: a word is as strong as the sum of
its sentences, a sentence as the weighted sum of its words over its length (and a few words more, so that short ones do not win), and one
round is one pass over the sentences. The matrix so applied is similar to a positive semi-definite one, so rounds do not swing. All numbers are whole: the ranking
does not depend on the order of sums.

Words are of three kinds. Those of most sentences, MAX_TERMS at most, are sent to the tasks with their strengths. A word of one sentence is as strong as that sentence
and stays with it as a number. Only what is between them is shuffled, a row for each such word of a sentence, and meets tables that lie in buckets of the same keys.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences, words
from .shares import known

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Strengths are whole numbers up to about this.
SCALE = 1_000_000

#: Words added to the length of every sentence.
MORE_WORDS = 8

#: Words of all categories that are sent to the tasks with their numbers, and then with their strengths.
MAX_TERMS = 2_000_000

#: Bits for each word that is neither sent nor of one sentence, up to 2**MOST_BITS bits in all: a word of one sentence is shuffled like them once in so many times.
BITS_PER_TERM = 16
MOST_BITS = 28

#: Weighted strengths are summed in two parts, of this many low bits and of the rest, so that no sum is too large for 64 bits.
LOW_BITS = 31

#: Words whose sums of one task are a row.
BLOCK = 8192

#: The rounds of a category are over once no word's share of its strongest changes by more.
TOLERANCE = 0.001

#: Rounds whose shuffled files are kept.
ROUNDS_KEPT = 4

NODE = ["category", "row_id", "at"]


@dataclass
class Strengths:
    """Strengths y of all words but those of one sentence, and by category the largest weighted and the largest strength of its words that weigh."""

    sent: np.ndarray
    joined: DataFrame | None  # term, code, w, y
    most: np.ndarray
    top: np.ndarray


class SentenceGraph:
    """Sentences and the words that link them, written to a folder that all executors share.

    ``texts`` holds (category, row_id, summary); rows without a category or a text are left out. Copies of a sentence in a category are one node, at its first place
    (row_id, then place in the text). A word weighs the whole part of log2(sentences of the category / those with it): words in more than half of them weigh nothing.
    Sentences and words go by 64-bit hashes, which are drawn anew until no two share one. The categories are sent to the tasks.
    """

    def __init__(self, texts: DataFrame, folder: str, max_terms: int = MAX_TERMS):
        self.spark, self.folder = texts.sparkSession, folder
        conf = self.spark.conf
        self.buckets = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
        rows = known(texts, "category", "summary").select("category", "row_id", "summary")
        cut = rows.select("category", "row_id", F.posexplode(sentences(F.col("summary"))).alias("at", "sentence"))
        check = F.xxhash64("category", "sentence")
        for seed in count(1):
            single = cut.groupBy(F.xxhash64(F.lit(seed), "category", "sentence").alias("node")).agg(
                F.min(F.struct("row_id", "at", "category", "sentence")).alias("first"), F.bit_or(check).alias("checks")
            )
            self.nodes = self._kept(f"nodes-{seed}", single.select("node", "first.*", "checks").withColumn("checks", F.col("checks") != check), "node")
            if not self.nodes.agg(F.max("checks")).first()[0]:  # else the copies of a node are not one sentence
                break
        sizes = self.nodes.groupBy("category").agg(F.count("*").alias("n")).orderBy("category").collect()
        self.categories, self.sizes = [r["category"] for r in sizes], np.array([r["n"] for r in sizes], np.int64)
        held = self.nodes.select("category", F.explode(_own(F.col("sentence"))).alias("word"))
        counted = held.groupBy("category", "word").agg(F.count("*").alias("n"))
        for seed in count(1):
            terms = self._kept(f"terms-{seed}", counted.select("category", F.xxhash64(F.lit(seed), "category", "word").alias("term"), "n"))
            if not terms.groupBy("term").agg(F.count("*").alias("n")).agg(F.max("n") > 1).first()[0]:
                break
        from_n = _sent_from(terms, max_terms)
        table = terms.filter(F.col("n") >= from_n).toArrow()  # at most max_terms
        order = np.argsort(table.column("term").to_numpy())
        self.n = table.column("n").to_numpy()[order]
        self.code = pc.index_in(table.column("category").combine_chunks(), value_set=pa.array(self.categories, table.schema.field("category").type)).to_numpy()[order]
        self.w = _weights(self.sizes[self.code], self.n)
        self.w_single = _weights(self.sizes, np.ones_like(self.sizes))  # of the words of one sentence
        joined = terms.filter((F.col("n") > 1) & (F.col("n") < from_n)).select("term")
        n_joined = joined.count()
        self.sent = not n_joined
        self.links = self._kept("links", self._numbered(seed, table.column("term").to_numpy()[order], _marked(joined, n_joined)), "node")
        singles = terms.filter("n = 1").groupBy("category").agg(F.lit(SCALE).cast("bigint").alias("top")).collect()
        codes = {category: i for i, category in enumerate(self.categories)}
        self.first_singles = np.zeros(len(codes), np.int64)
        self.first_singles[[codes[r["category"]] for r in singles]] = SCALE
        self.spread = None
        if not self.sent:
            rare = self.links.filter(F.size("joined") > 0).select("node", "code", F.explode("joined").alias("term"))
            nodes = rare.groupBy("term").agg(F.first("code").alias("code"), F.collect_list("node").alias("nodes"))
            all_nodes = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "code int, n_all bigint")
            n = F.size("nodes").cast("bigint")
            weighed = nodes.join(F.broadcast(all_nodes), "code").select("term", "code", F.expr("length(bin(n_all div size(nodes))) - 1").cast("bigint").alias("w"), n.alias("n"), "nodes")
            self.spread = self._kept("spread", weighed, "term")

    def _numbered(self, seed: int, terms: np.ndarray, marks: np.ndarray | None) -> DataFrame:
        """Every sentence with the places of its words among those sent, the words to join, and how many it alone has; no row moves."""
        shared = self.spark.sparkContext.broadcast((terms, marks, self.categories))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, marks, categories = shared.value
            for batch in batches:
                sizes = batch.column("terms").value_lengths().to_numpy().astype(np.int64)
                flat, node = batch.column("terms").flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                place = np.searchsorted(terms, flat)
                sent = place < len(terms)
                sent[sent] = terms[place[sent]] == flat[sent]
                joined = ~sent
                if marks is None:
                    joined[:] = False
                else:
                    bit = flat[joined] & (len(marks) * 8 - 1)
                    joined[joined] = (marks[bit >> 3] >> (bit & 7)) & 1 > 0
                single = np.bincount(node[~sent & ~joined], minlength=len(sizes))
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(node[own], minlength=len(sizes))))), pa.int32()), pa.array(held[own], kind))
                    for own, held, kind in ((sent, place, pa.int32()), (joined, flat, pa.int64()))
                ]
                code = pc.index_in(batch.column("category"), value_set=pa.array(categories, batch.column("category").type))
                numbers = [pa.array(x, pa.int32()) for x in (sizes, single)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), code, *numbers, *lists], names=["node", "code", "n_terms", "n_single", "ids", "joined"])

        hashed = F.transform(_own(F.col("sentence")), lambda word: F.xxhash64(F.lit(seed), "category", word))
        kinds = "node bigint, code int, n_terms int, n_single int, ids array<int>, joined array<bigint>"
        return self.nodes.select("node", "category", hashed.alias("terms")).mapInArrow(numbered, kinds)

    def _kept(self, name: str, table: DataFrame, by: str | None = None) -> DataFrame:
        """``table`` written to the folder, in place of one of that name; ``by`` a key, it lies in buckets that are joined without a shuffle."""
        writer, path = table.write.mode("overwrite").option("compression", "zstd"), f"{self.folder}/{name}"
        if by is None:
            writer.parquet(path)
            return self.spark.read.schema(table.schema).parquet(path)
        entry = f"sentence_graph_{uuid.uuid4().hex}"
        writer.format("parquet").bucketBy(self.buckets, by).option("path", path).saveAsTable(entry)
        kept = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")  # out of the session's catalogue; the files stay
        return kept

    def scores(self, rounds: int | None = None, tolerance: float | None = TOLERANCE) -> DataFrame:
        """``category, row_id, at, sentence, score`` of every node.

        Without ``rounds`` those of a category end once no word's share of its strongest changes by more than ``tolerance``, or whole numbers cannot tell any more,
        its strongest being below 1 / ``tolerance``. With ``rounds`` all categories have as many, or fewer if none changes by more (None: never fewer).
        A sentence without any word that weighs scores 0.
        """
        if rounds is None and tolerance is None:
            raise ValueError("rounds or a tolerance must end the iteration")
        joined = None if self.spread is None else self.spread.select("term", "code", "w", (F.col("n") * SCALE).alias("y"))
        strengths, values, seen, run = self._strengths(self.n * SCALE, joined, self.first_singles), None, set(), uuid.uuid4().hex
        moving = np.ones(len(self.sizes), bool)  # categories whose rounds go on
        for at in count(1) if rounds is None else range(1, rounds):
            earlier, before, values = strengths, values, self._valued(strengths, values, moving, f"{run}-{at % 2}")
            strengths = self._summed(values, f"{run}-{at % 2}")
            if tolerance is not None:
                moved = self._moved(earlier, strengths, before, values, moving, tolerance, 1 / tolerance if rounds is None and tolerance else 0)
                if not moved.any():
                    break
                moving = moved if rounds is None else moving
            if rounds is None:  # whole numbers that were there before would come again for ever
                state = values.agg(F.bit_xor(F.xxhash64("node", "x")), F.bit_xor(F.xxhash64("x", "node"))).first()
                if state in seen:
                    break
                seen.add(state)
            if at % ROUNDS_KEPT == 0:  # files that rounds have shuffled go once the JVM finds that nothing uses them
                self.spark.sparkContext._jvm.System.gc()
        values = self._valued(strengths, values, np.ones_like(moving), f"{run}-last")
        return self.nodes.join(values, "node").select(*NODE, "sentence", F.col("x").alias("score"))

    def _strengths(self, sent: np.ndarray, joined: DataFrame | None, singles: np.ndarray) -> Strengths:
        """``singles``: by category the largest value of a sentence that has words of its own."""
        top = np.where(self.w_single > 0, singles, 0)
        most, weigh = top * self.w_single, self.w > 0
        np.maximum.at(most, self.code[weigh], (self.w * sent)[weigh])
        np.maximum.at(top, self.code[weigh], sent[weigh])
        if joined is not None:
            for r in joined.filter("w > 0").groupBy("code").agg(F.max(F.col("w") * F.col("y")).alias("most"), F.max("y").alias("top")).collect():
                most[r["code"]], top[r["code"]] = max(most[r["code"]], r["most"]), max(top[r["code"]], r["top"])
        return Strengths(sent, joined, most, top)

    def _summed(self, values: DataFrame, name: str) -> Strengths:
        """Sums of the sentences' values by word."""
        n_sent, n_codes = len(self.n), len(self.sizes)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(n_sent + n_codes, np.int64)  # of words, and after them the largest values of sentences with words of their own
            for batch in batches:
                x, sizes = batch.column("x").to_numpy(), batch.column("ids").value_lengths().to_numpy()
                np.add.at(sums, batch.column("ids").flatten().to_numpy(), np.repeat(x, sizes))
                own = batch.column("n_single").to_numpy() > 0
                np.maximum.at(sums, n_sent + batch.column("code").to_numpy()[own], x[own])
            for start in range(0, len(sums), BLOCK):
                held = start + np.flatnonzero(sums[start : start + BLOCK])
                if len(held):
                    ends = pa.array([0, len(held)], pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, a) for a in (pa.array(held, pa.int32()), pa.array(sums[held]))]
                    yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), *lists], names=["block", "ids", "y"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(n_sent + n_codes, np.int64)
            for batch in batches:
                ids, y = (batch.column(name).flatten().to_numpy() for name in ("ids", "y"))
                np.add.at(sums, ids[ids < n_sent], y[ids < n_sent])
                np.maximum.at(sums, ids[ids >= n_sent], y[ids >= n_sent])
            held = np.flatnonzero(sums)
            for start in range(0, len(held), BLOCK):
                part = held[start : start + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(sums[part])], names=["id", "y"])

        valued = self.links.join(values, "node")
        parts = valued.select("code", "n_single", "ids", "x").mapInArrow(added, "block int, ids array<int>, y array<bigint>")
        table = parts.repartition("block").mapInArrow(summed, "id int, y bigint").toArrow()  # at most max_terms, and the categories
        sums = np.zeros(n_sent + n_codes, np.int64)
        sums[table.column("id").to_numpy()] = table.column("y").to_numpy()
        sent, singles = sums[:n_sent], sums[n_sent:]
        if self.spread is None:
            return self._strengths(sent, None, singles)
        sums = valued.filter(F.size("joined") > 0).select(F.explode("joined").alias("term"), "x").groupBy("term").agg(F.sum("x").alias("y"))
        joined = sums.join(self.spread.select("term", "code", "w"), "term").select("term", "code", "w", "y")
        return self._strengths(sent, self._kept(f"strengths-{name}", joined, "term"), singles)

    def _valued(self, strengths: Strengths, values: DataFrame | None, moving: np.ndarray, name: str) -> DataFrame:
        """The next value x of every sentence of the categories ``moving`` from the words' strengths and its own value before; 0 where no word weighs."""
        links = self.links
        links = links.join(values, "node", "left") if values is not None else links.withColumn("x", F.lit(SCALE).cast("bigint"))
        if self.spread is not None:
            weighed = strengths.joined.filter("w > 0").select("term", (F.col("w") * F.col("y")).alias("wy"))
            told = weighed.join(self.spread.select("term", "nodes"), "term").select(F.explode("nodes").alias("node"), "wy")
            high, low = F.shiftright("wy", LOW_BITS), F.col("wy").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
            links = links.join(told.groupBy("node").agg(F.sum(high).alias("high"), F.sum(low).alias("low")), "node", "left")
        else:
            links = links.withColumns({"high": F.lit(0).cast("bigint"), "low": F.lit(0).cast("bigint")})
        shared = self.spark.sparkContext.broadcast(((self.w * strengths.sent, strengths.most // SCALE + 1, self.w_single), moving))

        def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, moving = shared.value
            for batch in batches:
                x = np.where(moving[batch.column("code").to_numpy()], _values(batch, *known), batch.column("x").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(x, pa.int64())], names=["node", "x"])

        used = links.select("node", "code", "n_terms", "n_single", "ids", "x", F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("low", F.lit(0)).alias("low"))
        kept = self._kept(f"values-{name}", used.mapInArrow(valued, "node bigint, x bigint"), "node")
        shared.destroy()
        return kept

    def _moved(self, earlier: Strengths, now: Strengths, before: DataFrame | None, values: DataFrame, asked: np.ndarray, tolerance: float, least: float) -> np.ndarray:
        """Which of the categories ``asked`` have a word whose share of the strongest has changed by more than ``tolerance``, the strongest being more than ``least``; what is at hand is looked at first."""
        both = asked & (now.top > least) & (earlier.top > 0)
        weigh = (self.w > 0) & both[self.code]
        share = lambda s: s.sent[weigh] / s.top[self.code[weigh]]
        moved = np.zeros(len(both), bool)
        moved[self.code[weigh][np.abs(share(now) - share(earlier)) > tolerance]] = True

        def look(pairs: DataFrame) -> None:
            rows = [(i, int(now.top[i]), int(earlier.top[i])) for i in np.flatnonzero(both & ~moved & (self.w_single > 0)).tolist()]
            if rows:
                change = F.abs(F.col("y") / F.col("top") - F.col("old") / F.col("old_top"))
                largest = F.broadcast(self.spark.createDataFrame(rows, "code int, top bigint, old_top bigint"))
                moved[[r["code"] for r in pairs.join(largest, "code").filter(change > tolerance).select("code").distinct().collect()]] = True

        if now.joined is not None:
            look(now.joined.filter("w > 0").join(earlier.joined.select("term", F.col("y").alias("old")), "term"))
        old = before.select("node", F.col("x").alias("old")) if before is not None else self.links.select("node", F.lit(SCALE).cast("bigint").alias("old"))
        look(self.links.filter("n_single > 0").select("node", "code").join(values.withColumnRenamed("x", "y"), "node").join(old, "node"))
        return moved


def _own(sentence: Column) -> Column:
    return F.array_distinct(words(sentence))


def _weights(n_all: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The whole part of log2(n_all / n)."""
    return np.frexp((n_all // n).astype(np.float64))[1].astype(np.int64) - 1


def _sent_from(terms: DataFrame, max_terms: int) -> int:
    """The fewest sentences that a word must be in so that no more than ``max_terms`` words are in so many; two at least."""
    most, total = 1 << 16, 0
    by_size = terms.filter("n > 1").groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("n_terms"))
    for n, n_terms in sorted(map(tuple, by_size.collect()), reverse=True):  # at most 65,536 rows of two numbers
        total += n_terms
        if total > max_terms:
            return n + 1 if n < most else 1 << 62
    return 2


def _marked(terms: DataFrame, n: int) -> np.ndarray | None:
    """A bit for each of the ``n`` terms, by the low bits of their hashes, put together by blocks on the executors."""
    if not n:
        return None
    size = 1 << min(MOST_BITS, max(15, (BITS_PER_TERM * n).bit_length()))
    bit = F.col("term").bitwiseAND(F.lit(size - 1))
    # blocks and positions begin at 1, as for bitmaps
    placed = terms.select((bit + 1).alias("bit"))
    blocks = placed.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("held"))
    marks = np.zeros(size >> 3, np.uint8)
    for r in blocks.toLocalIterator():  # at most 2**MOST_BITS bits
        held = np.frombuffer(bytes(r.held), np.uint8)
        start = (r.block - 1) * len(held)
        marks[start : start + len(held)] = held[: len(marks) - start]
    return marks


def _values(batch: pa.RecordBatch, weighted: np.ndarray, divisors: np.ndarray, w_single: np.ndarray) -> np.ndarray:
    """The next values of a batch's sentences; the sums of their words in two parts, so that they are exact whatever their size."""
    column = lambda name: batch.column(name).to_numpy()
    sizes, code, mask = batch.column("ids").value_lengths().to_numpy().astype(np.int64), column("code"), (1 << LOW_BITS) - 1
    high, low = column("high").copy(), column("low") + w_single[code] * column("n_single") * column("x")
    linked = np.flatnonzero(sizes)
    if len(linked):
        starts, held = (np.cumsum(sizes) - sizes)[linked], weighted[batch.column("ids").flatten().to_numpy()]
        high[linked] += np.add.reduceat(held >> LOW_BITS, starts)
        low[linked] += np.add.reduceat(held & mask, starts)
    high, low = high + (low >> LOW_BITS), low & mask
    length = column("n_terms").astype(np.int64) + MORE_WORDS
    return (((high // length) << LOW_BITS) + (((high % length) << LOW_BITS) + low) // length) // divisors[code]


def graph_summaries(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n strongest sentences of every category in reading order: ``category, summary``; of equals the earlier one."""
    place = Window.partitionBy("category").orderBy(F.desc("score"), "row_id", "at")
    chosen = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
    lines = chosen.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("row_id", "at", "sentence"))).alias("lines"))
    return lines.select("category", F.array_join(F.transform("lines", lambda r: r["sentence"]), " ").alias("summary"))
