"""Conversions of texts, names, bits and maps, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_escape(text: Column) -> Column:
    """text with a backslash before each character that a regular expression gives a meaning."""
    return F.regexp_replace(text, r"([\\().|^$*+?\[\]])", r"\\$1")


def non_printable(text: Column) -> Column:
    """How many characters are control characters or beyond ASCII."""
    return F.length(F.regexp_replace(text, r"[\x20-\x7F]", ""))


def element_counts(array: Column) -> Column:
    """value and n of the distinct elements of an array, in order of first occurrence."""
    return F.transform(F.array_distinct(array), lambda x: F.struct(x.alias("value"), F.size(F.filter(array, lambda y: y.eqNullSafe(x))).alias("n")))


def name_encode(name: Column) -> Column:
    """A PDF name with every character but NUL as # and its hexadecimal number of bytes in Latin-1."""
    bare = F.regexp_replace(name, "^/", "")
    code = F.lower(F.hex(F.encode(bare, "ISO-8859-1")))
    return F.concat(F.lit("/"), F.replace(F.regexp_replace(code, "(..)", "#$1"), F.lit("#00"), F.lit("\0")))


def name_decode(name: Column) -> Column:
    """A PDF name with its #xx codes decoded, as Latin-1."""
    pieces = F.split(name, r"(?=#[0-9A-Fa-f]{2})")
    one = lambda x: F.when(x.rlike("^#[0-9A-Fa-f]{2}"), F.concat(F.decode(F.unhex(F.substring(x, 2, 2)), "ISO-8859-1"), F.substring(x, F.lit(4), F.length(x)))).otherwise(x)
    return F.array_join(F.transform(pieces, one), "")


#: Control characters and what they are written as in a string.
CONTROLS = (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def string_escape(text: Column) -> Column:
    """A PDF string's brackets, backslashes that begin no octal code, and control characters escaped.

    What follows a backslash stays as it is.
    """
    out = F.regexp_replace(text, r"(?<!\\)(?:[()]|\\(?![0-7]))", r"\\$0")
    for plain, written in CONTROLS:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def octal_encode(text: Column) -> Column:
    """Every byte of a Latin-1 text as a backslash and three octal digits."""
    each = F.regexp_extract_all(F.hex(F.encode(text, "ISO-8859-1")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(each, lambda x: F.concat(F.lit("\\"), F.lpad(F.conv(x, 16, 8), 3, "0"))), "")


def octal_decode(text: Column) -> Column:
    """Octal codes of up to three digits as Latin-1 characters; other characters stay."""
    pieces = F.split(text, r"(?=\\[0-7])")
    code = lambda x: F.regexp_extract(x, r"^\\([0-7]{1,3})", 1)
    byte = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.conv(code(x), 8, 10).cast("int").bitwiseAND(F.lit(255))), 2, "0")), "ISO-8859-1")
    one = lambda x: F.when(code(x) != "", F.concat(byte(x), F.regexp_replace(x, r"^\\[0-7]{1,3}", ""))).otherwise(x)
    return F.array_join(F.transform(pieces, one), "")


def bits(number: Column, width: int = 8) -> Column:
    """A number in binary digits, with zeros to the left; null where it has more of them."""
    code = F.bin(number)
    return F.when(F.length(code) <= width, F.lpad(code, width, "0"))


def bits_of(data: Column) -> Column:
    """The binary digits of all bytes."""
    code = F.hex(data)
    each = F.regexp_extract_all(code, F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(each, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")


def numbers(data: Column, width: int = 8) -> Column:
    """The numbers that bytes hold in components of `width` bits; a rest of fewer is left out."""
    groups = F.regexp_extract_all(bits_of(data), F.lit(f"([01]{{{width}}})"), F.lit(1))
    return F.transform(groups, lambda x: F.conv(x, 2, 10).cast("long"))


def bytes_of(digits: Column) -> Column:
    """The bytes that binary digits make, eight at a time; a rest of fewer is a byte with zeros to the right."""
    groups = F.regexp_extract_all(digits, F.lit("([01]{1,8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(groups, lambda x: F.lpad(F.conv(F.rpad(x, 8, "0"), 2, 16), 2, "0")), ""))


def number_hex(number: Column, size: int) -> Column:
    """A number as so many bytes, the highest first; null where it needs more."""
    code = F.hex(number)
    return F.when(F.length(code) <= 2 * size, F.unhex(F.lpad(code, 2 * size, "0")))


def number_text(number: Column, digits: int) -> Column:
    """A number in so many decimal digits; null where it needs more."""
    text = number.cast("string")
    return F.when(F.length(text) <= digits, F.lpad(text, digits, "0"))


def merge_maps(a: Column, b: Column, depth: int = 1, path: str = "") -> Column:
    """Maps of maps, `depth` levels of them, as one; different values of one key are an error that names it."""

    def one(k, x, y):
        if depth > 1:
            return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge_maps(x, y, depth - 1))
        return F.when(x.isNull(), y).when(y.isNull() | (x == y), x).otherwise(F.raise_error(F.concat(F.lit("Conflict at "), k)).cast("string"))

    return F.map_zip_with(a, b, one)


#: Classes of failures of a request, and how each is written; others by their own message.
FAILURES = {"Timeout": "Timeout error", "TooManyRedirects": "Too many redirects", "HTTPError": "HTTP error", "SSLError": "SSLError", "ConnectionError": "Connection error"}


def failure_text(kind: Column, message: Column) -> Column:
    """What is written for a failed request, null where there was no failure."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FAILURES.items()], F.when(kind.isNotNull(), message))
