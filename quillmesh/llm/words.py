"""Word expressions that stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is between words: all of ASCII but digits and lower-case letters, once A-Z are lower-cased.
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII only take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def item_words(text: Column) -> Column:
    """The words of a whole text; null has none. Splitting is several times faster than extracting matches."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ITEM_GAP, -1), "")


def word_hashes(words: Column) -> Column:
    """A hash of each word."""
    return F.transform(words, lambda x: F.xxhash64(x))


def run_hash(hashes: Column, at: Column, size: int, seed: int = 0) -> Column:
    """A hash of the run of `size` words that begins at `at`, from the words' hashes."""
    return F.xxhash64(F.lit(seed), *[F.get(hashes, at + j if j else at) for j in range(size)])
