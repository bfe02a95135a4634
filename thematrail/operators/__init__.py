"""Operators: plain functions from DataFrame to DataFrame.

Canonical tables
    mentions  row_id, entity, grp, category, mentions [, summary]
    names     row_id, entity, grp, name            name lists: names instead of name
    docs      doc_id, entity, grp, text
    pages     page_id, page_number, entity, grp, link, text, embedding
    turns     conv_id, turn, role, text
"""
