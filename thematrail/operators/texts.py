"""Texts rolled up per category or over a whole table.

A roll-up is emitted in chunks: the rows of a category with
``row_id div rows_per_chunk`` in common. row_id is unique in a category, so a
chunk holds at most ``rows_per_chunk`` texts whatever the size of the category,
and every category is spread over many tasks. Chunks in order, joined by the
separator, are the full text; a table of up to ``rows_per_chunk`` rows has one.

``text_chunks`` and what is built on it cut by characters instead, also within a text,
so that a chunk is bounded however long the texts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered_text
from .filters import keep_keys
from .shares import known, top_keys

ROWS_PER_CHUNK = 10_000

#: Characters of a chunk that is bounded by its length.
CHUNK_CHARS = 1 << 20
#: Row ids that share a block of the prefix sum, and blocks that share a block of blocks.
BLOCK_ROWS = 10_000

# Fixed value: paragraph written for one contribution.
ROLE_PARAGRAPH = "Rôle des Banques Publiques de Développement dans le fichier %s :\n%s\n\n"
# Fixed value: how a missing text prints in a paragraph.
NULL_TEXT = "nan"


def _chunk(rows_per_chunk: int) -> Column:
    return F.expr(f"row_id div {int(rows_per_chunk)}")


def text_by_category(df: DataFrame, top_k: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Summaries of every category joined by a blank, in row order; missing ones are left out.

    ``top_k`` keeps the categories with most mentions only.
    """
    if top_k is not None:
        df = keep_keys(df, top_keys(df, "category", "mentions", top_k), "category")
    rows = known(df, "category", "summary").select("category", _chunk(rows_per_chunk).alias("chunk"), "row_id", "summary")
    return rows.groupBy("category", "chunk").agg(
        F.count("*").alias("n_rows"), ordered_text(F.col("row_id"), F.col("summary"), " ").alias("text")
    )


def _prefix(rows: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """``rows`` with ``before``: the sizes of the rows of the group before this one."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0).cast("bigint")))


def text_chunks(rows: DataFrame, separator: str, keys: Sequence[str] = (), chunk_chars: int = CHUNK_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Texts of each key joined in row order and cut every ``chunk_chars`` characters: (keys, chunk, n_chars, text).

    ``rows`` has the keys, row_id (unique in a key) and text; null texts and rows without row_id are left out, null is a
    key like another, other columns are not looked at. Chunk c holds the characters from c * chunk_chars on, so chunks
    in order, put together with nothing between, are the whole text, and none is longer however long the texts are. A
    key without any character has no chunk.

    Places are prefix sums of lengths in three steps: blocks of blocks, blocks, rows. No window sees more than
    ``block_rows`` rows but the first, which has one row for the square of it. A text goes to each chunk it reaches
    into by its part alone.
    """
    keys = list(keys)
    one = [*keys, "one"]  # a table without keys is one group
    rows = rows.filter(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select(
        *keys, F.lit(0).alias("one"), F.col("row_id").cast("bigint").alias("row_id"), F.concat(F.lit(separator), "text").alias("text")
    )
    rows = rows.withColumn("size", F.length("text").cast("bigint")).withColumn("block", F.expr(f"row_id div {int(block_rows)}"))
    rows = rows.withColumn("super", F.expr(f"block div {int(block_rows)}"))
    blocks = rows.groupBy(*one, "super", "block").agg(F.sum("size").alias("size"))
    supers = _prefix(blocks.groupBy(*one, "super").agg(F.sum("size").alias("size")), one, ["super"], "size")

    def shifted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Add the place at which each block of ``right`` begins to the places within it."""
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
        joined = left.alias("l").join(right.select(*on, F.col("before").alias("begin")).alias("r"), same)
        return joined.select("l.*", "begin").withColumn("before", F.col("before") + F.col("begin")).drop("begin")

    blocks = shifted(_prefix(blocks, [*one, "super"], ["block"], "size"), supers, [*one, "super"])
    rows = shifted(_prefix(rows, [*one, "super", "block"], ["row_id", "text"], "size"), blocks, [*one, "super", "block"])
    # the separator before the very first text falls away: the whole text begins behind it
    start, lead, per = F.col("before") - F.lit(len(separator)), F.lit(len(separator)), F.lit(int(chunk_chars)).cast("bigint")
    rows = rows.select(*keys, "row_id", "text", F.greatest(start, F.lit(0)).alias("start"), (start + F.col("size")).alias("stop"), (F.col("before") == 0).alias("first"))
    rows = rows.filter(F.col("stop") > F.col("start"))
    reached = F.sequence(F.expr(f"start div {int(chunk_chars)}"), F.expr(f"(stop - 1) div {int(chunk_chars)}"))
    parts = rows.select("*", F.explode(reached).alias("chunk"))
    low, high = F.greatest("start", F.col("chunk") * per), F.least("stop", (F.col("chunk") + 1) * per)
    skipped = F.when(F.col("first"), lead).otherwise(F.lit(0))
    part = F.substring(F.col("text"), (low - F.col("start") + skipped + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select(*keys, "chunk", low.alias("low"), part.alias("part"))
    chunks = parts.groupBy(*keys, "chunk").agg(ordered_text(F.col("low"), F.col("part"), "").alias("text"))
    return chunks.select(*keys, "chunk", F.length("text").cast("bigint").alias("n_chars"), "text")


def category_chunks(df: DataFrame, top_k: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``text_by_category`` in chunks of ``chunk_chars`` characters (see ``text_chunks``)."""
    if top_k is not None:
        df = keep_keys(df, top_keys(df, "category", "mentions", top_k), "category")
    rows = known(df, "category", "summary").select("category", "row_id", F.col("summary").alias("text"))
    return text_chunks(rows, " ", ["category"], chunk_chars)


def context_chunks(df: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``entity_context`` in chunks of ``chunk_chars`` characters (see ``text_chunks``)."""
    return text_chunks(df.select("row_id", entity_paragraph().alias("text")), "\n", chunk_chars=chunk_chars)


def entity_paragraph(paragraph: str = ROLE_PARAGRAPH, null_text: str = NULL_TEXT) -> Column:
    shown = [F.coalesce(F.col(c), F.lit(null_text)) for c in ("entity", "role_summary")]
    return F.format_string(paragraph, *shown)


def entity_context(df: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One paragraph per row, joined by a line feed in row order."""
    rows = df.select(_chunk(rows_per_chunk).alias("chunk"), "row_id", entity_paragraph().alias("paragraph"))
    return rows.groupBy("chunk").agg(
        F.count("*").alias("n_rows"), ordered_text(F.col("row_id"), F.col("paragraph"), "\n").alias("text")
    )


def attach_by_key(keys: DataFrame, texts: DataFrame, heading: str = "**%s** : %s") -> DataFrame:
    """Each category with its own text and a heading; categories without text are left out."""
    joined = keys.select("category").join(texts, "category")
    return joined.withColumn("entry", F.format_string(heading, F.col("category").cast("string"), F.col("summary")))
