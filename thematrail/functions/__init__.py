"""Column expressions shared by the operators; all of them run inside the JVM."""

from .columns import lead_rank, ordered_text, percent, strip, WHITESPACE
from .text import bound, delimited_items, raw_sentences, sentences, words

__all__ = [
    "WHITESPACE", "bound", "delimited_items", "lead_rank", "ordered_text",
    "percent", "raw_sentences", "sentences", "strip", "words",
]
