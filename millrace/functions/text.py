"""Keyword tokens. A dictionary segmenter can be put in place of ``tokens`` as any function from column to array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def tokens(text: Column, pattern: str = WORDS) -> Column:
    """Different lower-case words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def split_words(df: DataFrame, text: str, word: str = "word", tokenizer=tokens) -> DataFrame:
    """One row for each word; a text without words keeps one row with a null word."""
    return df.withColumn(word, F.explode_outer(tokenizer(F.col(text))))
