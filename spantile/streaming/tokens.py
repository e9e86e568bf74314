"""Streams: tokens and matches of texts as they arrive.  Each text is by itself, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from ..operators.match import match_texts
from ..operators.tokens import sentences, tagged, words
from ..plans.pattern import Grammar


def streamed_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token rows of a stream of texts: key, sent, idx and what ``tagged`` adds."""
    return tagged(words(sentences(docs, key, text), [key, "sent"], "sentence"))


def streamed_matches(texts: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """Raw matches of a stream of texts with their tokens (keys, tokens array<struct<surface, feature>>)."""
    return match_texts(texts, grammar, keys)
