"""URLs in escaped strings of scripts. Code is read as text and never run."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An assignment of an escaped string, how long its content must be, and what in it is a URL.
ESCAPED = re.compile(r"(\w*)\s*=\s*unescape\((.*?)\)", re.S)
LEAST = 150
URL = re.compile(rb"https?://.*\Z", re.S)
UNIT = re.compile(r"%u([0-9a-fA-F]{2})([0-9a-fA-F]{2})|%([0-9a-fA-F]{2})|(.)", re.S)


def content(code: str, expression: str, seen: frozenset = frozenset()) -> str:
    """What a sum of strings and variables holds; a variable's first assignment counts, and one that leads to itself is empty."""
    out = []
    for part in re.sub(r"[\n\r\t ]", "", expression).split("+"):
        if len(part) > 1 and part[0] in "\"'" and part[-1] in "\"'":
            out.append(part[1:-1])
        elif part and part not in seen and (m := re.search(rf"(?<!\w){re.escape(part)}\s*=\s*(.*?)[,;]", code, re.S)):
            out.append(content(code, m[1], seen | {part}))
    return "".join(out)


def plain_bytes(escaped: str) -> bytes:
    """Bytes of %uXXXX (low byte first), and of %XX and other characters with a zero after each, as scripts hold them."""
    if "%" not in escaped:
        return escaped.encode("latin-1", "replace")
    out = bytearray()
    for high, low, one, char in UNIT.findall(escaped):
        out += bytes([int(low, 16), int(high, 16)]) if high else bytes([int(one, 16) if one else ord(char) & 255, 0])
    return bytes(out)


def found(code: str | None) -> list[str]:
    urls = []
    for _, expression in ESCAPED.findall(code or ""):
        held = content(code, expression) if "+" in expression or "%" not in expression else expression.strip()[1:-1]
        if len(held) > LEAST and (m := URL.search(plain_bytes(held))):
            urls.append(m[0].decode("latin-1"))
    return list(dict.fromkeys(urls))


def hidden_urls(code: Column) -> Column:
    """The distinct URLs that a script's long escaped strings end in, in order; variables are followed."""
    run = F.pandas_udf(lambda s: pd.Series([found(x) for x in s], index=s.index, dtype=object), "array<string>")
    return run(code)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
