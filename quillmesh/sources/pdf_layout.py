"""The layout of PDF files: where their parts lie, their cross-reference entries, and their trailers."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import pdf, pdf_filters

PARTS = "path string, version int, part string, id int, start long, size long"
ENTRIES = "path string, version int, id int, generation int, kind string, start long, holder int, matches boolean"
TRAILERS = "path string, version int, root int, info int, size int, prev long, encrypted boolean, ident binary, hidden boolean"
TABLE = re.compile(rb"(?<![A-Za-z])xref\s+((?:\d+\s+\d+\s+(?:\d{10}\s\d{5}\s[nf]\s*)*)+)")
SECTION = re.compile(rb"(\d+)\s+(\d+)\s+((?:\d{10}\s\d{5}\s[nf]\s*)*)")
ENTRY = re.compile(rb"(\d{10})\s(\d{5})\s([nf])")
#: What entries of a cross-reference stream say by their first field.
KINDS = {0: "free", 1: "used", 2: "compressed"}


def versions(data: bytes):
    """Number, start and bytes of each version, its end mark included; what follows the last mark is a version if it isn't blank."""
    start = version = 0
    for m in [*re.finditer(rb"%%EOF", data), None]:
        end = m.end() if m else len(data)
        if m or data[start:].strip():
            yield version, start, data[start:end]
        start, version = end, version + 1


def parts(data: bytes) -> list[dict]:
    """Header, objects, tables, trailers, pointers and end marks in the order in which they lie."""
    out = []
    for version, base, body in versions(data):
        found = [("header", None, m.span()) for m in re.finditer(rb"%PDF-\d+\.\d+", body)]
        inside = []
        for m in pdf.OBJECT.finditer(body):
            inside.append(m.span())
            found.append(("object", int(m[1]) & 0x7FFFFFFF, m.span()))
        outer = lambda at: not any(a <= at < b for a, b in inside)
        for name, pattern in (("xref", TABLE), ("trailer", re.compile(rb"trailer\b")), ("startxref", re.compile(rb"startxref\s+\d+")), ("eof", re.compile(rb"%%EOF"))):
            found += [(name, None, m.span()) for m in pattern.finditer(body) if outer(m.start())]
        out += [{"version": version, "part": n, "id": i, "start": base + a, "size": b - a} for n, i, (a, b) in sorted(found, key=lambda x: x[2])]
    return out


def numbers(value) -> list[int]:
    return [int(v) for v in value] if isinstance(value, list) and all(isinstance(v, int) for v in value) else []


def hidden_tables(body: bytes):
    """Dictionary and decoded stream of a version's cross-reference streams."""
    for m in pdf.OBJECT.finditer(body):
        if b"/XRef" not in m[3]:
            continue
        d, end = pdf.read_value(m[3])
        if isinstance(d, dict) and d.get("Type") == "XRef":
            s = re.compile(rb"\s*stream(?:\r\n|\n|\r)?").match(m[3], end)
            raw = re.split(rb"\r?\n?endstream", m[3][s.end() :], maxsplit=1)[0] if s else b""
            names, parms = d.get("Filter", []), d.get("DecodeParms", [])
            names, parms = names if isinstance(names, list) else [names], parms if isinstance(parms, list) else [parms]
            yield d, pdf_filters.decode(raw, [str(n) for n in names], parms)[0]


def entries(data: bytes) -> list[dict]:
    """Cross-reference entries of all versions, from tables and streams; matches: whether that object begins where one says."""
    out = []
    begins = lambda oid, at: re.compile(rb"\s*%d\s+\d+\s+obj\b" % oid).match(data, at) is not None

    def add(version, oid, generation, kind, start, holder=None):
        matches = begins(oid, start) if kind == "used" else None
        out.append({"version": version, "id": oid & 0x7FFFFFFF, "generation": generation & 0x7FFFFFFF, "kind": kind, "start": start if kind == "used" else None, "holder": holder, "matches": matches})

    for version, _, body in versions(data):
        for table in TABLE.finditer(body):
            for section in SECTION.finditer(table[1]):
                for k, e in enumerate(ENTRY.finditer(section[3])):
                    add(version, int(section[1]) + k, int(e[2]), "used" if e[3] == b"n" else "free", int(e[1]))
        for d, stream in hidden_tables(body):
            widths, index = numbers(d.get("W")), numbers(d.get("Index")) or [0, d["Size"] if isinstance(d.get("Size"), int) else 0]
            if len(widths) != 3 or not sum(widths):
                continue
            at = 0
            for first, count in zip(index[::2], index[1::2]):
                for oid in range(first, first + min(count, (len(stream) - at) // sum(widths))):
                    fields = []
                    for w in widths:
                        fields.append(int.from_bytes(stream[at : at + w], "big") if w else None)
                        at += w
                    kind = KINDS.get(1 if fields[0] is None else fields[0], "other")
                    add(version, oid, 0 if kind == "compressed" else fields[2] or 0, kind, fields[1] or 0, (fields[1] or 0) & 0x7FFFFFFF if kind == "compressed" else None)
    return out


def trailers(data: bytes) -> list[dict]:
    """What the trailers of all versions name; hidden: written as a cross-reference stream."""
    out = []
    ref = lambda v: int(v) & 0x7FFFFFFF if isinstance(v, pdf.Ref) else None
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, (bool, pdf.Ref)) and abs(v) < 2**31 else None
    for version, _, body in versions(data):
        found = [(pdf.read_value(body, m.end())[0], False) for m in re.finditer(rb"trailer\s*(?=<<)", body)]
        found += [(d, True) for d, _ in hidden_tables(body)]
        for d, hidden in found:
            if isinstance(d, dict):
                ident = d.get("ID")
                ident = ident[0] if isinstance(ident, list) and ident and isinstance(ident[0], bytes) else None
                out.append({"version": version, "root": ref(d.get("Root")), "info": ref(d.get("Info")), "size": whole(d.get("Size")), "prev": whole(d.get("Prev")), "encrypted": "Encrypt" in d, "ident": ident, "hidden": hidden})
    return out


def _table(pdfs: DataFrame, read, columns: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])

    def batches(source):
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in read(content or b"")], schema=schema)

    return pdfs.select("path", "content").mapInArrow(batches, columns)


def file_parts(pdfs: DataFrame) -> DataFrame:
    """A row for each part of files (path, content)."""
    return _table(pdfs, parts, PARTS)


def file_entries(pdfs: DataFrame) -> DataFrame:
    """A row for each cross-reference entry of files (path, content)."""
    return _table(pdfs, entries, ENTRIES)


def file_trailers(pdfs: DataFrame) -> DataFrame:
    """A row for each trailer of files (path, content)."""
    return _table(pdfs, trailers, TRAILERS)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
