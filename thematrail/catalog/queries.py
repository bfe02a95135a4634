from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, conversation, cooccurrence, cube, extraction, filters, lexicon, names, postings, retrieval, sentence_graph, shares, summaries, texts
from ..plans import reports
from ..session import shared_folder
from ..sources import cached, canonical, load_csv, load_pages, write_report
from ..sources.delimited import NUMBERED_THEMES, whole_numbers
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]

GROUPS = ["BUILDING", "MACHINERY"]
CATEGORIES = ["Brand#1", "Brand#3", "Brand#7", "Brand#12"]
CHOSEN_NAMES = ["red gear", "cold ring"]
PAGE_GROUPS = ["fr", "de"]
ROWS_PER_CHUNK = 250
CHUNK_CHARS = 100_000
BLOCK_TURNS = 4
PAGE_CHARS = 500


def queries() -> dict[str, Query]:
    return {**_sums(), **_stored_sums(), **_selections(), **_graph(), **_names(), **_texts(), **_retrieval(), **_extraction(), **_files()}


def _on_mentions(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(inputs.mentions(spark, folder))


def _on_names(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(names.explode_names(inputs.name_lists(spark, folder)))


def _sums() -> dict[str, Query]:
    return {
        "sum_by_category": _on_mentions(lambda m: shares.sum_by(m, ["category"])),
        "sum_by_group_category": _on_mentions(lambda m: shares.sum_by(m, ["grp", "category"])),
        "sum_by_entity": _on_mentions(lambda m: shares.sum_by(m, ["entity"])),
        "total_mentions": _on_mentions(shares.total),
        "category_share": _on_mentions(shares.category_share),
        "group_category_share": _on_mentions(shares.group_category_share),
        "top_contributors": _on_mentions(shares.top_contributors),
        "entity_row_share": _on_mentions(shares.entity_row_share),
    }


def _stored_sums() -> dict[str, Query]:
    """The dashboard's figures from stored sums, after two loads, of odd and of even rows."""

    def stored(answer: Callable[[cube.ShareCube], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            rows = inputs.mentions(spark, folder)
            sums = cube.ShareCube(spark, f"{shared_folder(spark)}/sums-{uuid.uuid4().hex}", "grp string, entity string, category string")
            even = F.pmod("row_id", F.lit(2)) == 0
            sums.load(rows.filter(even), "even")
            sums.load(rows.filter(~even | even.isNull()), "odd")
            return answer(sums)

        return run

    chosen = {"grp": GROUPS, "category": CATEGORIES}
    return {
        "stored_category_share": stored(lambda c: shares.category_share(c.cells(["category"]))),
        "stored_group_category_share": stored(lambda c: shares.group_category_share(c.cells(["grp", "category"]))),
        "stored_top_contributors": stored(lambda c: shares.top_contributors(c.cells(["entity"]))),
        "stored_filtered_category_share": stored(lambda c: shares.category_share(c.cells(["category"], {"grp": GROUPS}))),
        "stored_filter_stats": stored(lambda c: c.filter_stats(chosen)),
    }


def _selections() -> dict[str, Query]:
    chosen = {"grp": GROUPS, "category": CATEGORIES}
    return {
        "filter_members": _on_mentions(lambda m: filters.filter_members(m, chosen)),
        "filter_members_all": _on_mentions(lambda m: filters.filter_members(m, {"grp": ["All", "BUILDING"], "category": ["All"]})),
        "filter_members_empty": _on_mentions(lambda m: filters.filter_members(m, {"grp": []})),
        "filtered_category_share": _on_mentions(lambda m: shares.category_share(filters.filter_members(m, {"grp": GROUPS}))),
        "domain_groups": _on_mentions(lambda m: filters.domain_values(m, "grp")),
        "domain_entities": _on_mentions(lambda m: filters.domain_values(m, "entity")),
        "domain_categories": _on_mentions(lambda m: filters.domain_values(m, "category")),
        "filter_stats": _on_mentions(lambda m: filters.filter_stats(filters.filter_members(m, chosen))),
        "top_categories": _on_mentions(lambda m: shares.top_keys(m, "category", "mentions", 5)),
        "top_category_rows": _on_mentions(lambda m: filters.keep_keys(m, shares.top_keys(m, "category", "mentions", 5), "category")),
        "preview": lambda spark, folder: shares.preview(inputs.theme_texts(spark, folder)),
    }


def _graph() -> dict[str, Query]:
    def gated(m: DataFrame) -> DataFrame:
        return filters.gate_min_distinct(cooccurrence.cooccurrence(m), "category", source=m)

    def nodes(m: DataFrame) -> DataFrame:
        return cooccurrence.graph_nodes(cooccurrence.global_top_categories(m), cooccurrence.cooccurrence(m))

    return {
        "entity_top_rows": _on_mentions(cooccurrence.top_rows_per_entity),
        "global_top_categories": _on_mentions(cooccurrence.global_top_categories),
        "entity_items": _on_mentions(lambda m: cooccurrence.items_by(cooccurrence.top_rows_per_entity(m), "entity", "category").select(
            "entity", F.array_join("items", ",").alias("items")
        )),
        "entity_pairs": _on_mentions(lambda m: cooccurrence.pairs_within(
            cooccurrence.items_by(cooccurrence.top_rows_per_entity(m), "entity", "category")
        ).groupBy("a", "b").agg(F.count("*").alias("n"))),
        "cooccurrence_edges": _on_mentions(cooccurrence.cooccurrence),
        "filtered_cooccurrence": _on_mentions(lambda m: reports.theme_report(m, {"grp": GROUPS})["edges"]),
        "gated_cooccurrence": _on_mentions(gated),
        "closed_gate_cooccurrence": _on_mentions(lambda m: gated(filters.filter_members(m, {"category": ["Brand#1"]}))),
        "graph_nodes": _on_mentions(nodes),
        "graph_degree": _on_mentions(lambda m: cooccurrence.graph_degree(nodes(m), cooccurrence.cooccurrence(m))),
    }


def _names() -> dict[str, Query]:
    def found(spark: SparkSession, folder: str) -> DataFrame:
        lists = extraction.find_names(inputs.documents(spark, folder), inputs.NAMES).withColumnRenamed("doc_id", "row_id")
        return names.name_group_share(names.explode_names(lists))

    def filtered(spark: SparkSession, folder: str) -> DataFrame:
        lists = inputs.name_lists(spark, folder)
        return reports.name_report(lists, names.explode_names(lists), GROUPS, ["All"], CHOSEN_NAMES)["name_group_share"]

    return {
        "filtered_name_group_share": filtered,
        "domain_list_groups": lambda spark, folder: filters.domain_values(inputs.name_lists(spark, folder), "grp"),
        "domain_name_entities": _on_names(lambda n: filters.domain_values(n, "entity")),
        "domain_names": _on_names(lambda n: filters.domain_values(n, "name")),
        "explode_names": _on_names(lambda n: n),
        "filter_name_list": lambda spark, folder: filters.filter_name_list(inputs.name_lists(spark, folder), "names", CHOSEN_NAMES),
        "count_by_name": _on_names(lambda n: shares.count_by(n, ["name"])),
        "count_by_name_group": _on_names(lambda n: shares.count_by(n, ["name", "grp"])),
        "name_share_top10": _on_names(names.name_share),
        "name_group_share_top10": _on_names(names.name_group_share),
        "found_name_group_share": found,
    }


def _texts() -> dict[str, Query]:
    def by_category(spark: SparkSession, folder: str) -> DataFrame:
        return reports.summary_report(inputs.theme_texts(spark, folder))["per_category"]

    def reduced(spark: SparkSession, folder: str) -> DataFrame:
        return summaries.summarize_reduce(summaries.summarize_map(inputs.theme_texts(spark, folder)))

    def ranked(spark: SparkSession, folder: str) -> DataFrame:
        graph = sentence_graph.SentenceGraph(inputs.theme_texts(spark, folder), f"{shared_folder(spark)}/sentences-{uuid.uuid4().hex}")
        return graph.scores()

    return {
        "sentence_ranks": lambda spark, folder: ranked(spark, folder).drop("at"),
        "graph_summaries": lambda spark, folder: sentence_graph.graph_summaries(ranked(spark, folder)),
        "text_by_category_top5": lambda spark, folder: texts.text_by_category(inputs.theme_texts(spark, folder), 5, ROWS_PER_CHUNK),
        "text_by_category_all": lambda spark, folder: texts.text_by_category(inputs.theme_texts(spark, folder), None, ROWS_PER_CHUNK),
        "category_chunks": lambda spark, folder: texts.category_chunks(inputs.theme_texts(spark, folder), None, CHUNK_CHARS),
        "category_chunks_top5": lambda spark, folder: texts.category_chunks(inputs.theme_texts(spark, folder), 5, CHUNK_CHARS),
        "context_chunks": lambda spark, folder: texts.context_chunks(inputs.roles(spark, folder), CHUNK_CHARS),
        "entity_context": lambda spark, folder: texts.entity_context(inputs.roles(spark, folder), ROWS_PER_CHUNK),
        "summary_key_terms": lambda spark, folder: summaries.key_terms(inputs.theme_texts(spark, folder)),
        "summarize_map": lambda spark, folder: summaries.summarize_map(inputs.theme_texts(spark, folder)),
        "summarize_reduce": reduced,
        "summary_by_category": by_category,
        "summary_of_leading": lambda spark, folder: reports.summary_report(inputs.theme_texts(spark, folder))["whole"],
        "role_summary": lambda spark, folder: reports.role_summary(inputs.roles(spark, folder)),
    }


def _retrieval() -> dict[str, Query]:
    where = filters.metadata_filter

    def nearest(**options) -> Query:
        return lambda spark, folder: retrieval.knn(
            inputs.label_queries(spark, folder), inputs.vectors(spark, folder),
            **{name: value() if callable(value) else value for name, value in options.items()},
        )

    def by_cells(spark: SparkSession, folder: str, wanted: Column | None = None) -> DataFrame:
        index = cells.build_cells(inputs.vectors(spark, folder), f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}")
        return cells.cell_search(index, inputs.label_queries(spark, folder), where=wanted)

    def sources(spark: SparkSession, folder: str) -> DataFrame:
        return retrieval.list_sources(nearest()(spark, folder), inputs.page_texts(spark, folder))

    def prompts(spark: SparkSession, folder: str) -> DataFrame:
        return reports.answer_prompts(
            inputs.turns(spark, folder), inputs.conversation_queries(spark, folder), inputs.vectors(spark, folder),
            inputs.page_texts(spark, folder), inputs.SYSTEM_TEXT,
        )

    def index(spark: SparkSession, folder: str) -> postings.LexicalIndex:
        return postings.build_index(inputs.page_texts(spark, folder), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")

    def asked(spark: SparkSession, folder: str) -> DataFrame:
        return inputs.turns(spark, folder).filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), "text")

    def shown(hits: DataFrame) -> DataFrame:
        return hits.select("query_id.conv_id", "query_id.turn", "page_id", "score", "rank")

    def lexical(spark: SparkSession, folder: str) -> DataFrame:
        return shown(postings.lexical_search(index(spark, folder), asked(spark, folder)))

    def expanded(spark: SparkSession, folder: str) -> DataFrame:
        history = conversation.history_before(inputs.turns(spark, folder)).select(F.struct("conv_id", "turn").alias("query_id"), F.col("history").alias("text"))
        return shown(postings.expanded_search(index(spark, folder), asked(spark, folder), history))

    return {
        "knn_top10": nearest(),
        "knn_filtered_pre": nearest(where=lambda: where(groups=PAGE_GROUPS), mode="pre"),
        "knn_filtered_post": nearest(where=lambda: where(groups=PAGE_GROUPS), mode="post"),
        "knn_group_replaces_entity": nearest(where=lambda: where(entities=["src1"], groups=PAGE_GROUPS), mode="pre"),
        "knn_empty_selection": nearest(where=lambda: where(entities=[], groups=[])),
        "knn_by_blocks": nearest(max_queries=3),
        "knn_by_cells": by_cells,
        "knn_by_cells_filtered": lambda spark, folder: by_cells(spark, folder, where(groups=PAGE_GROUPS)),
        "list_sources": sources,
        "stuff_context": lambda spark, folder: retrieval.stuff_context(sources(spark, folder)),
        "history_before": lambda spark, folder: conversation.history_before(inputs.turns(spark, folder)),
        "history_before_in_blocks": lambda spark, folder: conversation.history_before(inputs.turns(spark, folder), BLOCK_TURNS),
        "history_blocks": lambda spark, folder: conversation.history_blocks(inputs.turns(spark, folder), BLOCK_TURNS),
        "assemble_prompt": prompts,
        "tfidf_vectors": lambda spark, folder: postings.page_weights(index(spark, folder)),
        "tfidf_nearest": lexical,
        "expanded_nearest": expanded,
    }


def _extraction() -> dict[str, Query]:
    def documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: operator(inputs.documents(spark, folder))

    def compiled(docs: DataFrame) -> DataFrame:
        return extraction.compile_mentions(*[extraction.structured_results(docs, found) for found in (inputs.THEMES, inputs.AREAS)])

    def shares_found(docs: DataFrame) -> DataFrame:
        found = [extraction.count_mentions(docs, lexicon) for lexicon in (inputs.THEMES, inputs.AREAS)]
        return shares.category_share(extraction.compile_mentions(*found))

    def opening(found: Callable[[DataFrame], DataFrame], **options) -> Query:
        return lambda spark, folder: found(lexicon.term_hits(inputs.documents(spark, folder), inputs.opening_lexicon(spark, folder), **options))

    def table_names(spark: SparkSession, folder: str) -> DataFrame:
        return lexicon.names_found(lexicon.term_hits(inputs.documents(spark, folder), lexicon.name_table(inputs.benchmark_names(spark, folder))))

    return {
        "lexicon_mentions": opening(lexicon.mentions_found),
        "lexicon_mentions_joined": opening(lexicon.mentions_found, automaton_bytes=0),
        "lexicon_passages": opening(lexicon.passages_found),
        "lexicon_passages_joined": opening(lexicon.passages_found, automaton_bytes=0),
        "lexicon_names": table_names,
        "split_pages": documents(lambda d: extraction.split_pages(d, PAGE_CHARS)),
        "count_mentions": documents(lambda d: extraction.count_mentions(d, inputs.THEMES)),
        "example_passages": documents(lambda d: extraction.example_passages(d, inputs.THEMES)),
        "importance": documents(lambda d: extraction.importance(extraction.count_mentions(d, inputs.THEMES))),
        "find_names": documents(lambda d: extraction.find_names(d, inputs.NAMES)),
        "structured_results": documents(lambda d: extraction.structured_results(d, inputs.THEMES)),
        "compile_mentions": documents(compiled),
        "found_category_share": documents(shares_found),
    }


def _files() -> dict[str, Query]:
    def folder_for(spark: SparkSession) -> str:
        return f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"

    def csv(spark: SparkSession, folder: str) -> DataFrame:
        path = folder_for(spark)
        written = inputs.theme_texts(spark, folder).select(
            F.col("grp").alias("Groupe"), F.col("category").alias("Entity"), F.col("row_id").alias("ODD number"),
            F.col("mentions").alias("ODD count"), F.col("summary").alias("Summary"),
        )
        write_report(written, path, "csv")
        schema = "Groupe string, Entity string, `ODD number` bigint, `ODD count` bigint, Summary string"
        return canonical(load_csv(spark, path, schema), NUMBERED_THEMES)

    def parquet(spark: SparkSession, folder: str) -> DataFrame:
        path = folder_for(spark)
        write_report(shares.group_category_share(inputs.mentions(spark, folder)), path)
        return spark.read.parquet(path)

    def pages(spark: SparkSession, folder: str) -> DataFrame:
        path = folder_for(spark)
        found = inputs.table(spark, folder, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
        write_report(found.join(inputs.page_texts(spark, folder), "page_id", "left"), path)
        micro = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string"))
        return cached(load_pages(spark, path)).withColumn("components", F.array_join(micro, ",")).drop("embedding")

    def large_numbers(spark: SparkSession, folder: str) -> DataFrame:
        """Ids beyond 2^53 and missing counts, in two extracts with different orders of columns."""
        paths = [folder_for(spark), folder_for(spark)]
        rows = inputs.table(spark, folder, "documents").select(
            (F.lit(9007199254740993) + F.col("doc_id")).alias("ODD number"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string")).otherwise("None").alias("ODD count"),
            F.col("source").alias("Entity"), F.col("lang").alias("Groupe"), (F.col("doc_id") % 2).alias("part"),
        )
        write_report(rows.filter("part = 0").drop("part"), paths[0], "csv")
        write_report(rows.filter("part = 1").select("Groupe", "ODD count", "Entity", "ODD number"), paths[1], "csv")
        schema = "Groupe string, Entity string, `ODD number` bigint, `ODD count` bigint"
        return whole_numbers(canonical(load_csv(spark, paths, schema), NUMBERED_THEMES), "mentions")

    return {"csv_round_trip": csv, "report_round_trip": parquet, "stored_pages": pages, "csv_large_numbers": large_numbers}
