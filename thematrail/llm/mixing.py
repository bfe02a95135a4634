"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the sources in code point order, repeating; null comes last.
SOURCE_WEIGHTS = (5, 2, 1)

#: Sampling weight of a document by its quality label.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5, None: 1.0}

WORD = r"[^\x20\x09-\x0D]+"

#: Documents that are ordered together in one group of the prefix sum, on average.
BIN_ROWS = 10_000


def draw(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1] that depends on id and seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS, share_num: int = 3, share_den: int = 2, most: int = 2) -> DataFrame:
    """Words that each source is to give: (source, source_size) to (source, source_size, target).

    All targets sum up to share_num / share_den of all sizes, in proportion to the weights; none is
    above ``most`` times its source's size, and what is cut is reshared by weight until none is.
    With caps in the order of cap / weight the capped sources are a prefix, so the common level is found by
    prefix sums over one row per source. If all sources reach their caps, their caps are the targets.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int")).cast("bigint")
    s = sizes.select("source", "source_size", weight.alias("w"))
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    # in units of 1 / share_den words, all whole numbers
    s = s.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) * share_num - share_den * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    fits = F.col("source_size") * share_den * most * F.col("left_w") >= F.col("left") * F.col("w")
    level = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("w"), "left", "left_w"))).over(everything)
    s = s.withColumn("fits", fits).withColumn("level", level)
    shared = F.col("w") * F.col("level.left") / (share_den * F.col("level.left_w"))
    cap = (most * F.col("source_size")).cast("double")
    return s.select("source", "source_size", F.coalesce(F.least(cap, shared.cast("double")), cap).alias("target"))


def mix_sources(
    docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[int] = SOURCE_WEIGHTS, seed: int = 0, bin_rows: int = BIN_ROWS,
    carry: bool = False,
) -> DataFrame:
    """How often each document enters a mix that holds 150 % of all words, sources in proportion to their weights.

    Columns: doc_id, source, size (words), source_size, target (of its source), copies, taken = size * copies; with
    ``carry`` also ``row``, the whole input row. A source first gives as many complete epochs as fit into its
    target; for the rest its documents are ordered by exponential keys, -ln(u) / quality weight, and the prefix whose
    words come nearest to what is missing is taken. Keys depend on doc_id and seed alone, so reruns agree.

    ``labels`` (doc_id, quality) gives the quality weights; the best label of a document counts, none counts as 1.
    Null texts have size 0, null sources are one source, rows repeated are drawn alike and each counts; an empty
    table gives none. No source is ever one group: keys are cut into bins, whole bins are summed up to offsets and
    only documents within a bin are put in order.
    """
    n_bins = docs.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(bin_rows))).cast("bigint")).scalar()
    quality = F.lit(None).cast("int")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    rows = docs.select(*([F.struct("*").alias("row")] if carry else []), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    if labels is not None:
        best = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality")).filter("labelled IS NOT NULL")
        rows, quality = rows.join(best, F.col("doc_id") == F.col("labelled"), "left"), F.col("quality")
    weight = F.when(quality == 1, QUALITY_WEIGHTS[1]).when(quality == 0, QUALITY_WEIGHTS[0]).otherwise(QUALITY_WEIGHTS[None])
    rows = rows.select(
        *(["row"] if carry else []), "doc_id", "source", "size", (-F.ln(draw(F.col("doc_id"), seed)) / weight).alias("key"),
    )
    rows = rows.withColumn("bin", F.least(F.floor(n_bins * (1 - F.exp(-F.col("key")))), n_bins - 1).cast("bigint"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights)
    lower = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(F.col("source").alias("of"), F.col("bin").alias("at"), F.coalesce(F.sum("bin_size").over(lower), F.lit(0)).alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "target_source"), F.col("of").eqNullSafe(F.col("target_source")))
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")))
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    middle = F.col("start") + F.sum("size").over(inside) - F.col("size") / 2
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    joined = joined.withColumn("epochs", epochs.cast("bigint")).withColumn("middle", middle)
    copies = F.col("epochs") + F.when((rest > 0) & (F.col("middle") <= rest), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("bigint")).select(
        *(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    taken = mix_sources(docs, labels, seed=seed, carry=True).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
