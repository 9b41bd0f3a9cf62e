"""Ways from a PDF file's catalog to the URIs in it, the leaves of its page tree, and URIs found by their bytes alone.

A file is the unit of work, as for its objects: its graph is walked in the task that has parsed it, and gives plain rows.
"""

from __future__ import annotations

import sys
from collections import deque

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pdf

FACTS = "path string, uri string, uri_id int, rect_id int, llx double, lly double, urx double, ury double, way array<int>, is_in_catalog_path boolean, mediabox_id int, media_w double, media_h double, page_id int, tentative_page_num int, has_annot boolean, is_uri_unicode boolean"
PAGES = "path string, page int, page_id int, depth int, media_w double, media_h double, own_box boolean, n_pages int, counted boolean"


def ways(objects: dict[int, dict]) -> dict[int, list[int]]:
    """The way from the catalog to each object: the first of the shortest that pass an annotation and a media box, the end
    included, ids in their order; where none does, there is no way.

    Nodes are walked once for each of the two marks that a way has or has not, so the walk ends. A way visits no object twice.
    """
    marks = {i: (b"Annot" in r["raw"], b"MediaBox" in r["raw"]) for i, r in objects.items()}
    refs = {i: [t for t in pdf.references(r["value"]) if t in objects] for i, r in objects.items()}
    out: dict[int, list[int]] = {}
    todo = deque((i, marks[i], None) for i in pdf.catalogs_of(objects)[:1])
    seen = {(i, m) for i, m, _ in todo}
    while todo:
        step = todo.popleft()
        node, mark, _ = step
        if all(mark) and node not in out:
            out[node] = chain(step)
        for t in refs[node]:
            after = (mark[0] or marks[t][0], mark[1] or marks[t][1])
            if (t, after) not in seen and t not in chain(step):
                seen.add((t, after))
                todo.append((t, after, step))
    return out


def chain(step) -> list[int]:
    out = []
    while step is not None:
        out.append(step[0])
        step = step[2]
    return out[::-1]


def annotations(value):
    """Dictionaries with a URI of their own or of their action, wherever they are in a value, in order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if pdf.uri_of(v) is not None:
                yield v
            else:
                stack += reversed(v.values())
        elif isinstance(v, list):
            stack += reversed(v)


def facts(rows: list[dict]) -> list[dict]:
    """What is known of each URI of the newest versions: its object, the one with its rectangle, its way, box and page."""
    objects = pdf.newest(rows)
    way_to, leaves = ways(objects), [i for i, *_ in pdf.page_list(objects)]
    numbers = lambda v: pdf.four_numbers(objects, pdf.followed(objects, v))
    out = []
    for i, r in sorted(objects.items()):
        way = way_to.get(i, [])
        box_id, box = next(((w, b) for w in reversed(way) if isinstance(v := objects[w]["value"], dict) and (b := numbers(v.get("MediaBox"))) and round(b[2]) > 0 and round(b[3]) > 0), (None, None))
        page = next((w for w in way if w in leaves), None)
        for a in annotations(r["value"]):
            text = pdf.text_of(pdf.uri_of(a))
            rect_id, rect = i, numbers(a.get("Rect"))
            if rect is None:  # the nearest object above that has a rectangle and no URI
                rect_id, rect = next(((w, x) for w in reversed(way[:-1]) if isinstance(v := objects[w]["value"], dict) and pdf.uri_of(v) is None and (x := numbers(v.get("Rect")))), (None, None))
            found = rect or [None] * 4
            out.append({"uri": text, "uri_id": i, "rect_id": rect_id, "llx": found[0], "lly": found[1], "urx": found[2], "ury": found[3], "way": way, "is_in_catalog_path": bool(way), "mediabox_id": box_id, "media_w": float(round(box[2])) if box else None, "media_h": float(round(box[3])) if box else None, "page_id": page, "tentative_page_num": leaves.index(page) + 1 if page is not None else None, "has_annot": rect is not None, "is_uri_unicode": text != "UnicodeDecodeError"})
    return out


def pages(rows: list[dict]) -> list[dict]:
    """The leaves of the page tree in order; counted: whether the root's own count is right."""
    objects = pdf.newest(rows)
    leaves = pdf.page_list(objects)
    roots = [pdf.followed(objects, objects[c]["value"].get("Pages")) for c in pdf.catalogs_of(objects)]
    counted = any(isinstance(x, dict) and pdf.followed(objects, x.get("Count")) == len(leaves) for x in roots)
    return [{"page": n, "page_id": i, "depth": depth, "media_w": abs(box[2] - box[0]) if box else None, "media_h": abs(box[3] - box[1]) if box else None, "own_box": own, "n_pages": len(leaves), "counted": counted} for n, (i, depth, box, own) in enumerate(leaves)]


def _table(pdfs: DataFrame, read, columns: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])

    def batches(source):
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in read(pdf.parse(content or b""))], schema=schema)

    return pdfs.select("path", "content").mapInArrow(batches, columns)


def uri_facts(pdfs: DataFrame) -> DataFrame:
    """A row for each URI of files (path, content)."""
    return _table(pdfs, facts, FACTS)


def page_tree(pdfs: DataFrame) -> DataFrame:
    """A row for each page of files (path, content)."""
    return _table(pdfs, pages, PAGES)


#: Fixed value: a URI in a dictionary, found by its bytes.
URI_BYTES = r"(?s)<<.*?/URI\s*\((.*?)\).*?>>"


def byte_uris(objects: DataFrame) -> DataFrame:
    """URIs that objects (of pdf.objects) have in their bytes, parsed or not: path, version, id, pos and uri as it is written.

    The pattern is applied to each object; over a whole file it would reach from the first dictionary to the last URI.
    """
    raw = F.decode("raw", "ISO-8859-1")
    found = F.regexp_extract_all(raw, F.lit(URI_BYTES), F.lit(1))
    one = objects.select("path", "version", "id", F.posexplode(found).alias("pos", "uri"))
    text = F.try_validate_utf8(F.encode("uri", "ISO-8859-1").cast("string"))
    clean = F.trim(F.replace(F.replace(F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("("), F.lit("")), F.lit(")"), F.lit("")), F.lit("/URI"), F.lit("")))
    return one.withColumn("uri", F.coalesce(clean, F.lit("UnicodeDecodeError")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
