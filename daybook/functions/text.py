"""Text helpers: cleaning, labels, word counts, durations, tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.fixed_values import INVISIBLE_MARKS

# Every blank a chat export or a word splitter has to treat as a space.
BLANK = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# A token: a run of three or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{3,}"


def clean_line(line: Column) -> Column:
    """Drop direction marks and the byte-order mark; a no-break space becomes a space."""
    return F.translate(line, "\u00a0" + INVISIBLE_MARKS, " ")


def snake_case(label: Column) -> Column:
    """``Strength training`` -> ``strength_training``; an empty label is NULL."""
    words = F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_")
    return F.when(label != "", F.btrim(words, F.lit("_")))


def word_count(text: Column) -> Column:
    """Number of blank-separated words; NULL for a missing or empty text."""
    return F.when(
        F.length(text) > 0, F.regexp_count(text, F.lit(BLANK.replace("[\\s", "[^\\s", 1) + "+"))
    ).cast("int")


def duration_minutes(text: Column) -> Column:
    """``2700.5s`` -> minutes; a bare number counts as seconds."""
    spelled = F.regexp_extract(text, r"(?i)([\d.]+)\s*s", 1)
    bare = F.regexp_extract(text, r"^\s*([\d.]+)\s*$", 1)
    seconds = F.coalesce(F.nullif(spelled, F.lit("")), F.nullif(bare, F.lit("")))
    return seconds.try_cast("double") / 60.0


def safe_int(text: Column) -> Column:
    """Text to int with rounding (``3.7`` -> 4, ``1e3`` -> 1000); NULL if not a number."""
    return F.round(text.try_cast("double")).try_cast("int")


def tokens(text: Column) -> Column:
    """Lowercased tokens of a text, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """``size(tokens(text))`` without building the array."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def with_term_counts(df: DataFrame, text: str, into: str = "term_counts") -> DataFrame:
    """Add an array of (term, tf) per row, in term order.

    The token array is sorted and cut into runs of equal terms, so a document never leaves
    its row: counting needs no shuffle. Each step is a column of its own, because an
    expression inside a lambda is evaluated once per element.
    """
    token, at = F.col("_tokens"), F.col("_starts")
    last = F.size(token) - 1
    is_start = lambda i: (i == 0) | (
        F.get(token, i) != F.get(token, F.greatest(i - 1, F.lit(0)))
    )
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(
        at,
        lambda i, n: F.struct(
            F.get(token, i).alias("term"),
            (F.coalesce(F.get(at, n + 1), last + 1) - i).alias("tf"),
        ),
    )
    return (
        df.withColumn("_tokens", F.sort_array(tokens(F.col(text))))
        .withColumn("_starts", F.filter(every, is_start))
        .withColumn(into, runs)
        .drop("_tokens", "_starts")
    )


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if any of the words occurs anywhere in the text."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])
