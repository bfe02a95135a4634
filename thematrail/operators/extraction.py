"""From raw documents to pages, mention counts, passages, scores and names.

A lexicon is a mapping from category to its terms, kept in the program: a term is
one or more words, and is found as a run of whole words, without regard to case, full stops and
line ends. A run counts for the sentence it begins in.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bound, raw_sentences, strip, words

Lexicon = Mapping[str, Iterable[str]]


def split_pages(docs: DataFrame, max_chars: int = 3000) -> DataFrame:
    """Pages of a document: cut at form feeds, then after the last line that fits max_chars.

    A line longer than that is cut at max_chars. Done inside the row, without a
    shuffle; the pages in order hold the whole text but the form feeds.
    """
    pattern = r"(?s).{1,%d}(?:\n|\z)|.{%d}" % (max_chars, max_chars)
    parts = F.transform(F.split("text", "\f"), lambda part: F.regexp_extract_all(part, F.lit(pattern), F.lit(0)))
    paged = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.flatten(parts)).alias("at", "text"))
    return paged.withColumn("page_number", F.col("at") + 1).drop("at")


def _normal(term: str) -> str:
    import re

    return " ".join(re.findall(r"[^\W_]+", term.lower()))


def _terms(lexicon: Lexicon) -> dict[str, list[str]]:
    return {category: sorted({_normal(t) for t in terms} - {""}) for category, terms in lexicon.items()}


def _sizes(terms: Iterable[str]) -> list[int]:
    return sorted({len(t.split(" ")) for t in terms})


def _hits(text: Column, terms: Iterable[str]) -> Column:
    """Sentences that hold one of the terms: where they are, and every occurrence in them.

    Runs of words are put together only where a term's first word stands.
    """
    terms = sorted(set(terms))
    sizes = _sizes(terms)
    more = max(sizes, default=1) - 1
    firsts = sorted({t.split(" ")[0] for t in terms})

    def found(cut: Column) -> Column:
        def reach(s: Column, i: Column) -> Column:
            if not more:
                return s["words"]
            # as many sentences hold at least as many words, since those without words have been left out
            following = F.flatten(F.transform(F.slice(cut, i + 2, F.lit(more)), lambda x: x["words"]))
            return F.concat(s["words"], F.slice(following, F.lit(1), F.lit(more)))

        def at(tokens: Column, j: Column) -> Column:
            runs = F.array(*[F.when(F.size(tokens) >= j + n, F.array_join(F.slice(tokens, j + 1, F.lit(n)), " ") if n > 1 else tokens[j]) for n in sizes])
            return F.filter(runs, lambda run: run.isin(terms))

        def own(s: Column, i: Column) -> Column:
            starts = F.filter(F.transform(s["words"], lambda w, j: F.when(w.isin(firsts), j)), lambda j: j.isNotNull())
            runs = bound(reach(s, i), lambda tokens: F.flatten(F.transform(starts, lambda j: at(tokens, j))))
            return F.when(F.arrays_overlap(s["words"], F.array(*[F.lit(f) for f in firsts])), runs)

        return F.transform(cut, lambda s, i: F.struct(i.alias("at"), s["passage"].alias("passage"), own(s, i).alias("found")))

    if not terms:
        return F.array().cast("array<struct<at:int,passage:string,found:array<string>>>")
    cut = F.transform(raw_sentences(text), lambda s: F.struct(s.alias("passage"), words(s).alias("words")))
    held = F.filter(bound(F.filter(cut, lambda s: F.size(s["words"]) > 0), found), lambda s: F.size(s["found"]) > 0)
    return F.transform(held, lambda s: F.struct(s["at"].alias("at"), strip(s["passage"]).alias("passage"), s["found"].alias("found")))


def _category_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``hits`` of each (document, category) that has any; found inside the row, without a shuffle."""
    terms = _terms(lexicon)
    table = F.array(*[
        F.struct(F.lit(category).alias("category"), F.array(*[F.lit(t) for t in own]).cast("array<string>").alias("terms")) for category, own in terms.items()
    ]).cast("array<struct<category:string,terms:array<string>>>")

    def own_hits(entry: Column, hits: Column) -> Column:
        own = F.transform(hits, lambda h: F.struct(
            h["at"].alias("at"), h["passage"].alias("passage"),
            F.filter(h["found"], lambda t: F.array_contains(entry["terms"], t)).alias("found"),
        ))
        return F.filter(own, lambda h: F.size(h["found"]) > 0)

    found = bound(
        _hits(F.col("text"), [t for own in terms.values() for t in own]),
        lambda hits: F.transform(table, lambda e: F.struct(e["category"].alias("category"), own_hits(e, hits).alias("hits"))),
    )
    rows = docs.select("doc_id", "entity", "grp", "text").select(
        "doc_id", "entity", "grp", F.length("text").cast("bigint").alias("n_chars"),
        F.explode(F.filter(found, lambda c: F.size(c["hits"]) > 0)).alias("c"),
    )
    return rows.select("doc_id", "entity", "grp", "n_chars", "c.category", "c.hits")


def _n_mentions(hits: str) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + F.size(h["found"]))


def _best_passages(hits: str, n: int) -> Column:
    scored = F.transform(hits, lambda h: F.struct(
        (-F.size(F.array_distinct(h["found"]))).alias("minus"), h["at"].alias("at"), h["passage"].alias("passage")
    ))
    return F.slice(F.array_sort(scored), 1, n)


def count_mentions(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Explicit mentions per document and category, where there are any.

    The counts are complete inside each row. They are grouped all the same: texts
    are then read once however often the counts are used, as that shuffle of
    small rows is shared.
    """
    counted = _category_hits(docs, lexicon).withColumn("mentions", _n_mentions("hits"))
    return counted.groupBy("doc_id", "entity", "grp", "n_chars", "category").agg(F.sum("mentions").alias("mentions"))


def example_passages(docs: DataFrame, lexicon: Lexicon, n: int = 3) -> DataFrame:
    """The n sentences of a document that hold most different terms of a category, earlier ones first."""
    rows = _category_hits(docs, lexicon).select("doc_id", "category", F.posexplode(_best_passages("hits", n)).alias("at", "p"))
    return rows.select(
        "doc_id", "category", (F.col("at") + 1).alias("place"), (-F.col("p.minus")).alias("n_terms"), F.col("p.passage").alias("passage")
    )


#: Coarse ranges of rates for each doubling.
RANGES = 4


def importance(mentions: DataFrame) -> DataFrame:
    """Score 1 to 5 of each (document, category): the fifth of the category its mention rate falls in.

    The rate is mentions per 100,000 characters, unrounded; the score is
    ``1 + floor(5 * rows with a lower rate / all rows)`` of the category, so equal
    rates score alike. Equal rates are counted first, so however many rows share a rate, it is ranked as one row; rates are summed up in coarse
    ranges (quarters of a power of two), only those of one range are ever ranked together, and the ranges below add their counts.
    Rows without a category are left out.
    """
    rated = mentions.withColumn("rate", F.col("mentions") * 100000.0 / F.col("n_chars"))
    rates = rated.groupBy("category", "rate").agg(F.count("*").alias("n"))
    rates = rates.withColumn("range", F.coalesce(F.floor(F.log2("rate") * RANGES), F.lit(-(2**40))).cast("bigint"))
    ranges = rates.groupBy("category", "range").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("category").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        "category", "range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("category")).alias("whole")
    )
    below = Window.partitionBy("category", "range").orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)
    placed = rates.withColumn("within", F.coalesce(F.sum("n").over(below), F.lit(0))).join(starts, ["category", "range"])
    scores = placed.select("category", "rate", F.expr("1 + 5 * (start + within) div whole").cast("bigint").alias("score"))
    same = rated["category"].eqNullSafe(scores["category"]) & rated["rate"].eqNullSafe(scores["rate"])
    return rated.join(scores, same).drop(scores["category"], scores["rate"])


def find_names(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """Names found in each document as a list ``a, b, c``; NULL where none is. Done inside the row.

    Names that differ in case or punctuation only are all reported.
    """
    spelled = [(name, _normal(name)) for name in sorted(set(names)) if _normal(name)]
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("name")) for n, t in spelled]).cast("array<struct<term:string,name:string>>")
    found = F.array_distinct(F.flatten(F.transform(_hits(F.col("text"), [t for _, t in spelled]), lambda h: h["found"])))
    listed = bound(found, lambda f: F.transform(F.filter(table, lambda e: F.array_contains(f, e["term"])), lambda e: e["name"]))
    rows = docs.select("doc_id", "entity", "grp", "text")
    return rows.select("doc_id", "entity", "grp", F.nullif(F.array_join(listed, ", "), F.lit("")).alias("names"))


def structured_results(docs: DataFrame, lexicon: Lexicon, n_examples: int = 3) -> DataFrame:
    """One row per document and category found: mention_count, examples, importance_score.

    Grouping by every column, the examples too, lets one pass over the texts and
    one shuffle of result rows serve both the scores and their histogram.
    """
    examples = F.array_join(F.transform(_best_passages("hits", n_examples), lambda p: p["passage"]), "\n")
    found = _category_hits(docs, lexicon).withColumns({"mentions": _n_mentions("hits"), "examples": examples}).drop("hits")
    grouped = found.groupBy("doc_id", "entity", "grp", "n_chars", "category", "examples").agg(F.sum("mentions").alias("mentions"))
    return importance(grouped).select(
        "doc_id", "entity", "grp", "category", F.col("mentions").alias("mention_count"), "examples", F.col("score").alias("importance_score")
    )


def compile_mentions(*tables: DataFrame) -> DataFrame:
    """Result tables of several lexicons as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
