"""Tokenizers as column expressions. They are four different rules; see each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_terms(text: Column) -> Column:
    """Indexing: Unicode lower case, runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def ascii_terms(text: Column) -> Column:
    """Embedding: ASCII lower case only, runs of letters and digits; any other byte separates."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda x: x != "")


def shingle_words(text: Column) -> Column:
    """Dedup shingles: Unicode lower case, split at Unicode white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def shingles(text: Column, k: int) -> Column:
    """k-word shingles joined by blanks; fewer words give one short shingle, none gives none; k below 1 is 1."""
    k = max(k, 1)

    def made(words: Column) -> Column:
        n = F.size(words)
        full = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(full)

    return F.element_at(F.transform(F.array(shingle_words(text)), made), 1)


#: The words that a claim check doesn't count; with others its scores would differ.
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "of", "to", "and", "or", "in", "on", "at", "by", "for", "with", "as", "that", "this", "it", "its", "be", "has")


def content_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Claim checks: index terms without stop words, repeats kept."""
    return F.filter(index_terms(text), lambda x: ~x.isin(*stopwords))
