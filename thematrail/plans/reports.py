"""The tables behind each report, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.conversation import assemble_prompt, history_before
from ..operators.cooccurrence import cooccurrence, global_top_categories, graph_degree, graph_nodes
from ..operators.filters import domain_values, filter_members, filter_name_list, filter_stats, gate_min_distinct, keep_keys
from ..operators.names import name_group_share, name_share
from ..operators.retrieval import knn, list_sources, stuff_context
from ..operators.shares import category_share, group_category_share, preview, top_contributors, top_keys
from ..operators.summaries import summarize_map, summarize_reduce
from ..operators.texts import attach_by_key, entity_paragraph


def theme_report(mentions: DataFrame, selections: Mapping[str, Iterable] = {}) -> dict[str, DataFrame]:
    """Tables of a theme dashboard after filtering.

    Wrap the filtered table with ``sources.cached`` when several of them are written.
    """
    kept = filter_members(mentions, selections)
    edges = gate_min_distinct(cooccurrence(kept), "category", source=kept)
    top = gate_min_distinct(global_top_categories(kept), "category", source=kept)
    nodes = graph_nodes(top, edges)
    return {
        "groups": domain_values(mentions, "grp"),
        "entities": domain_values(mentions, "entity"),
        "categories": domain_values(mentions, "category"),
        "stats": filter_stats(kept),
        "category_share": category_share(kept),
        "group_category_share": group_category_share(kept),
        "top_contributors": top_contributors(kept),
        "edges": edges,
        "nodes": graph_degree(nodes, edges),
        "preview": preview(kept),
    }


def name_report(
    lists: DataFrame, names: DataFrame, groups: Iterable[str], entities: Iterable[str], chosen: Iterable[str]
) -> dict[str, DataFrame]:
    """Tables of the institution dashboard after filtering both name tables."""
    groups, entities, chosen = list(groups), list(entities), list(chosen)
    kept = filter_members(names, {"grp": groups, "entity": entities, "name": chosen})
    kept_lists = filter_name_list(filter_members(lists, {"grp": groups, "entity": entities}), "names", chosen)
    return {
        "groups": domain_values(lists, "grp"),
        "entities": domain_values(names, "entity"),
        "names": domain_values(names, "name"),
        "stats": filter_stats(kept_lists),
        "name_share": name_share(kept),
        "name_group_share": name_group_share(kept),
        "preview": preview(kept_lists),
    }


def summary_report(mentions: DataFrame, top_k: int | None = 5, n: int = 3) -> dict[str, DataFrame]:
    """Map and reduce summaries of the leading categories (of all with ``top_k=None``)."""
    if top_k is not None:
        mentions = keep_keys(mentions, top_keys(mentions, "category", "mentions", top_k), "category")
    per_category = summarize_map(mentions, n)
    keys = mentions.select("category").distinct()
    return {"per_category": attach_by_key(keys, per_category), "whole": summarize_reduce(per_category, n)}


def role_summary(lists: DataFrame, n: int = 3) -> DataFrame:
    """One summary over the role paragraphs of all rows."""
    return summarize_reduce(lists.withColumn("paragraph", entity_paragraph()), n, "row_id", "paragraph")


def answer_prompts(
    turns: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    page_texts: DataFrame,
    system_text: str,
    k: int = 10,
    where: Column | None = None,
) -> DataFrame:
    """Prompt of every user turn: retrieved context, history and question.

    Every question is searched on its own: ``queries`` holds (conv_id, turn, embedding).
    ``vectors`` and ``page_texts`` may be the same table of pages.
    """
    asked = queries.select(F.struct("conv_id", "turn").alias("query_id"), "embedding")
    contexts = stuff_context(list_sources(knn(asked, vectors, k, where), page_texts))
    return assemble_prompt(history_before(turns), contexts, system_text)
