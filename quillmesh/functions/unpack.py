"""Packed scripts made readable, without running them: words put back into base-n templates, and percent-encoded text."""

from __future__ import annotations

import re
import sys
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The call that ends a packed script: template, base, count and the words, split at bars.
PACKED = re.compile(r"}\s*\(\s*'((?:[^'\\]|\\.)*)'\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*'((?:[^'\\]|\\.)*)'\s*\.split\(\s*'\|'\s*\)", re.S)
HEAD = re.compile(r"eval\s*\(\s*function\s*\(\s*p\s*,\s*a\s*,\s*c\s*,\s*k\s*,\s*[er]")
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Layers that are taken off unless a caller asks for more.
ROUNDS = 64


def number(word: str, base: int) -> int | None:
    """The value of a word in a base up to 62, or null."""
    n = 0
    for c in word:
        d = DIGITS.find(c)
        if d < 0 or d >= base:
            return None
        n = n * base + d
    return n


def unpacked(script: str | None, rounds: int = ROUNDS) -> str | None:
    """A script with its layers of packing taken off; others come back as they are. More layers than rounds are an error."""
    for _ in range(rounds + 1):
        if not script:
            return script
        m = PACKED.search(script) if HEAD.search(script) else None
        if m:
            base, words = int(m[2]), m[4].split("|")
            if not 2 <= base <= len(DIGITS):
                return script

            def word(x: re.Match) -> str:
                n = number(x[0], base)
                return words[n] if n is not None and n < len(words) and words[n] else x[0]

            plain = re.sub(r"\b\w+\b", word, re.sub(r"\\(.)", r"\1", m[1]))
        elif "%20" in script and " " not in script.strip():
            plain = unquote(script)
        else:
            return script
        if plain == script:
            return script
        script = plain
    raise ValueError(f"more than {rounds} layers")


def unpack(script: Column, rounds: int = ROUNDS) -> Column:
    """script and whole of unpacked() over Arrow batches; where there are more layers, script is as it was and not whole."""

    def one(text):
        try:
            return unpacked(text, rounds), True
        except ValueError:
            return text, False

    run = F.pandas_udf(lambda s: pd.DataFrame([one(x) for x in s], columns=["script", "whole"], index=s.index), "script string, whole boolean")
    return run(script)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
