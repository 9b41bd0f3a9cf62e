"""PDF files as tables: objects of every version, and links with their place on a page.

A file is the unit of work: each is read and parsed by one task, from Spark's binary source, and gives plain rows.
Damaged parts are rows' errors, never failures. Nothing a file names is opened.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from . import pdf_crypt, pdf_filters

OBJECTS = "path string, version int, id int, kind string, tag string, refs array<int>, uri string, compressed_in int, raw binary, stream binary, errors array<string>"
LINKS = "path string, uri string, object_id int, page_id int, page int, llx double, lly double, urx double, ury double, media_w double, media_h double, in_catalog boolean"
OBJECT = re.compile(rb"(\d{1,10})\s+(\d{1,10})\s+obj\b(.*?)(?:endobj|(?=\b\d{1,10}\s+\d{1,10}\s+obj\b)|\Z)", re.S)
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%{}]*|(\d+)\s+(\d+)\s+R\b|[+-]?(?:\d+\.?\d*|\.\d+)|true\b|false\b|null\b|[^\s/<>\[\]()%]+)", re.S)
#: Single-character escapes in strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The id of an object that is referred to."""


class Name(str):
    pass


def read_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after the bracket at `at`."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            nxt = data[i + 1 : i + 2]
            if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                out.append(int(m[0], 8) & 255)
                i = m.end()
                continue
            if nxt not in (b"\r", b"\n"):
                out += ESCAPES.get(nxt, nxt)
            i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def read_value(data: bytes, at: int = 0):
    """The value at `at` and where it ends; nesting of any depth."""
    stack: list = []
    while m := TOKEN.match(data, at):
        token, at = m[1], m.end()
        if token == b"<<" or token == b"[":
            stack.append((token, []))
            continue
        if token in (b">>", b"]"):
            if not stack:
                return None, at
            mark, items = stack.pop()
            value = items if mark == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        elif token == b"(":
            value, at = read_string(data, m.end() - 1)
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))
        elif m[2]:
            value = Ref(m[2])
        elif token in (b"true", b"false", b"null"):
            value = {b"true": True, b"false": False, b"null": None}[token]
        else:
            try:
                value = float(token) if b"." in token else int(token)
            except ValueError:
                value = token.decode("latin-1")
        if not stack:
            return value, at
        stack[-1][1].append(value)
    return (stack[0][1] if stack else None), at


def references(value) -> list[int]:
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, Ref):
            out.append(int(v))
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
    return sorted(set(out))


def kind_of(value) -> str:
    for kinds, name in ((Ref, "reference"), (bool, "bool"), ((int, float), "number"), (Name, "name"), (bytes, "string"), (list, "array"), (dict, "dictionary"), (type(None), "null")):
        if isinstance(value, kinds):
            return name
    return "other"


def tag_of(value) -> str | None:
    """The dictionary's type; an action's kind follows it."""
    if not isinstance(value, dict):
        return None
    t, s = value.get("Type"), value.get("S")
    tag = f"/{t}" if isinstance(t, Name) else "/Annot" if value.get("Subtype") == "Link" and "Rect" in value else None
    return f"{tag or '/Action'} /{s}" if isinstance(s, Name) else tag


def uri_of(value) -> bytes | None:
    if not isinstance(value, dict):
        return None
    action = value.get("A")
    found = value.get("URI") if isinstance(value.get("URI"), bytes) else action.get("URI") if isinstance(action, dict) else None
    return found if isinstance(found, bytes) else None


def text_of(uri: bytes | None) -> str | None:
    """The URI as text, or a fixed word where it isn't UTF-8."""
    if uri is None:
        return None
    try:
        return uri.decode("utf-8").replace("\0", "").strip()
    except UnicodeDecodeError:
        return "UnicodeDecodeError"


def security(data: bytes, password: bytes) -> tuple[pdf_crypt.Handler | None, int | None, list[str]]:
    """The file's decryption, the id of the dictionary that describes it, and why there is none."""
    if b"/Encrypt" not in data:
        return None, None, []
    starts = [m.end() for m in re.finditer(rb"trailer\s*(?=<<)", data)]
    starts += [data.rfind(b"obj", 0, m.start()) + 3 for m in re.finditer(rb"/Type\s*/XRef\b", data)]
    for at in reversed(starts):
        try:
            trailer = read_value(data, at)[0]
            found = trailer.get("Encrypt") if isinstance(trailer, dict) else None
            if found is None:
                continue
            oid = int(found) if isinstance(found, Ref) else None
            if oid is not None:
                found = read_value(data, [m.end() for m in re.finditer(rb"(?<!\d)%d\s+\d+\s+obj\b" % oid, data)][-1])[0]
            ident = trailer.get("ID")
            return pdf_crypt.Handler(found, ident[0] if isinstance(ident, list) and ident and isinstance(ident[0], bytes) else b"", password), oid, []
        except Exception as e:
            return None, None, [str(e)]
    return None, None, []


def parse(data: bytes, password: bytes = b"") -> list[dict]:
    """Objects of all versions, those of object streams after the stream that holds them. Encrypted files open with their user password."""
    rows = []
    handler, described, refused = security(data, password)
    for version, part in enumerate(data.split(b"%%EOF")):
        if version and not part.strip():
            continue
        for m in OBJECT.finditer(part):
            errors: list[str] = []
            try:
                value, end = read_value(m[3])
            except Exception as e:
                value, end, errors = None, 0, [str(e)]
            stream = None
            oid, generation = int(m[1]) & 0x7FFFFFFF, int(m[2]) & 0xFFFF
            closed = handler is not None and oid != described and not (isinstance(value, dict) and value.get("Type") == "XRef")
            if closed:
                value = handler.strings(value, oid, generation)
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream(?:\r\n|\n|\r)?").match(m[3], end)):
                raw = re.split(rb"\r?\n?endstream", m[3][s.end() :], maxsplit=1)[0]
                names, parms = value.get("Filter", value.get("F", [])), value.get("DecodeParms", value.get("DP", []))
                names, parms = names if isinstance(names, list) else [names], parms if isinstance(parms, list) else [parms]
                own = any(n == "Crypt" for n in names)
                if closed and not own and (handler.metadata or value.get("Type") != "Metadata"):
                    raw = handler.open(raw, oid, generation, "stream")
                if own:
                    at = [i for i, n in enumerate(names) if n != "Crypt"]
                    names, parms = [names[i] for i in at], [parms[i] for i in at if i < len(parms)]
                stream, errors = pdf_filters.decode(raw, [str(n) for n in names if isinstance(n, Name)], parms)
            if stream is not None:
                kind = "stream"
            else:
                kind = kind_of(value)
            rows.append({"version": version, "id": int(m[1]) & 0x7FFFFFFF, "kind": kind, "value": value, "compressed_in": None, "raw": m[3].strip(), "stream": stream, "errors": errors + refused})
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream:
                first = value.get("First") if isinstance(value.get("First"), int) else 0
                head = [int(x) for x in re.findall(rb"\d+", stream[:first])]
                if len(head) % 2:
                    errors.append("odd number of entries")
                for oid, offset in zip(head[::2], head[1::2]):
                    inner, stop = read_value(stream, first + offset)
                    rows.append({"version": version, "id": oid, "kind": kind_of(inner), "value": inner, "compressed_in": int(m[1]), "raw": stream[first + offset : stop], "stream": None, "errors": []})
    return rows


def newest(rows: list[dict]) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for r in rows:
        if r["id"] not in out or r["version"] >= out[r["id"]]["version"]:
            out[r["id"]] = r
    return out


def followed(objects: dict[int, dict], v, hops: int = 32):
    """The value that a reference leads to."""
    while isinstance(v, Ref) and hops:
        v, hops = objects[v]["value"] if v in objects else None, hops - 1
    return v


def four_numbers(objects: dict[int, dict], v) -> list[float] | None:
    found = [followed(objects, x) for x in v] if isinstance(v, list) and len(v) == 4 else []
    return [float(x) for x in found] if found and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in found) else None


def catalogs_of(objects: dict[int, dict]) -> list[int]:
    return sorted(i for i, r in objects.items() if isinstance(r["value"], dict) and r["value"].get("Type") == "Catalog")


def page_list(objects: dict[int, dict]) -> list[tuple[int, int, list | None, bool]]:
    """Id, depth, media box (its own or the nearest above) and whether the box is its own, of the leaves of the page tree in order."""
    pages, walked = [], set()
    todo = [(objects[c]["value"].get("Pages"), None, 0) for c in reversed(catalogs_of(objects))]
    while todo:
        ref, box, depth = todo.pop()
        node = followed(objects, ref)
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref in walked:
            continue
        if isinstance(ref, Ref):
            walked.add(int(ref))
        own = four_numbers(objects, followed(objects, node.get("MediaBox")))
        kids = followed(objects, node.get("Kids"))
        if isinstance(kids, list):
            todo += [(k, own or box, depth + 1) for k in reversed(kids)]
        elif isinstance(ref, Ref):
            pages.append((int(ref), depth, own or box, own is not None))
    return pages


def links(rows: list[dict]) -> list[dict]:
    """Link annotations of the newest versions with their page, rectangle and the nearest media box above them."""
    objects = newest(rows)
    value = lambda v: followed(objects, v)
    numbers = lambda v: four_numbers(objects, v)
    seen, stack = set(), catalogs_of(objects)
    while stack:
        i = stack.pop()
        if i not in seen and i in objects:
            seen.add(i)
            stack += references(objects[i]["value"])
    pages = [(i, box) for i, _, box, _ in page_list(objects)]
    out, placed = [], set()

    def emit(annotation, own_id, page_id, page, box):
        uri = uri_of(annotation) or uri_of({"A": value(annotation.get("A"))})
        if uri is None:
            return
        rect = numbers(value(annotation.get("Rect"))) or [None] * 4
        w, h = (abs(box[2] - box[0]), abs(box[3] - box[1])) if box else (None, None)
        out.append({"uri": text_of(uri), "object_id": own_id, "page_id": page_id, "page": page, "llx": rect[0], "lly": rect[1], "urx": rect[2], "ury": rect[3], "media_w": w, "media_h": h, "in_catalog": page_id is not None or own_id in seen})

    for n, (page_id, box) in enumerate(pages):
        annots = value(objects[page_id]["value"].get("Annots")) if page_id in objects else None
        for a in annots if isinstance(annots, list) else []:
            if isinstance(v := value(a), dict):
                placed.add(int(a) if isinstance(a, Ref) else page_id)
                emit(v, int(a) if isinstance(a, Ref) else page_id, page_id, n, box)
    for i, r in sorted(objects.items()):
        if i not in placed and isinstance(r["value"], dict) and "Rect" in r["value"]:
            emit(r["value"], i, None, None, None)
    return out


def object_batches(batches):
    fields = [("path", pa.string()), ("version", pa.int32()), ("id", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("refs", pa.list_(pa.int32())), ("uri", pa.string()), ("compressed_in", pa.int32()), ("raw", pa.binary()), ("stream", pa.binary()), ("errors", pa.list_(pa.string()))]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = parse(content or b"")
            yield pa.RecordBatch.from_pylist([{"path": path, "version": r["version"], "id": r["id"], "kind": r["kind"], "tag": tag_of(r["value"]), "refs": references(r["value"]), "uri": text_of(uri_of(r["value"])), "compressed_in": r["compressed_in"], "raw": r["raw"], "stream": r["stream"], "errors": r["errors"]} for r in got], schema=pa.schema(fields))


def link_batches(batches):
    fields = [("path", pa.string()), ("uri", pa.string()), *[(n, pa.int32()) for n in ("object_id", "page_id", "page")], *[(n, pa.float64()) for n in ("llx", "lly", "urx", "ury", "media_w", "media_h")], ("in_catalog", pa.bool_())]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in links(parse(content or b""))], schema=pa.schema(fields))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all PDF files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def objects(pdfs: DataFrame) -> DataFrame:
    """A row for each object of each version of files (path, content)."""
    return pdfs.select("path", "content").mapInArrow(object_batches, OBJECTS)


def document_links(pdfs: DataFrame) -> DataFrame:
    """A row for each link of files (path, content)."""
    return pdfs.select("path", "content").mapInArrow(link_batches, LINKS)


for _module in (__name__, pdf_crypt.__name__, pdf_filters.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])
