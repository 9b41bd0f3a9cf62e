"""Files other than PDFs as tables: archives, lists, labelled folders, public suffixes; reports to write."""

from __future__ import annotations

import gzip
import io
import sys
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, body string, error string"
#: Archives within archives are opened to this depth unless a reader asks for another; deeper ones are rows that say so.
DEPTH = 16


def members(name: str, content: bytes, depth: int = DEPTH):
    """(name, text, error) of an archive's members one at a time, those of inner archives under outer/inner; .gz members unpacked.

    depth: archives within each other that are opened; one beyond is a row with the error "nested too deep".
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception as e:
        yield name, None, str(e)
        return
    for info in archive.infolist():
        inner = f"{name}/{info.filename}" if name else info.filename
        if info.is_dir():
            continue
        try:
            data = archive.read(info)
            if inner.endswith(".zip"):
                if depth > 1:
                    yield from members(inner, data, depth - 1)
                else:
                    yield inner, None, "nested too deep"
                continue
            if inner.endswith(".gz"):
                inner, data = inner[:-3], gzip.decompress(data)
            yield inner, data.decode("utf-8", "replace"), None
        except Exception as e:
            yield inner, None, str(e)


def archive_members(zips: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, member, body and error of all files in archives (path, content); a damaged archive is one row with its error."""
    schema = pa.schema([(n, pa.string()) for n in ("path", "member", "body", "error")])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, body, error in members("", content or b"", depth):
                    yield pa.RecordBatch.from_pylist([{"path": path, "member": name, "body": body, "error": error}], schema=schema)

    return zips.select("path", "content").mapInArrow(run, MEMBERS)


def archives(spark: SparkSession, folder: str, depth: int = DEPTH) -> DataFrame:
    """archive_members() of the .zip files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    return archive_members(found, depth)


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first; columns that are null there come from second."""
    rest = [c for c in first.columns if c not in keys]
    joined = first.alias("a").join(second.alias("b"), keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in rest])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines of text files that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def suffix_kind(line: Column) -> dict[str, Column]:
    """suffix and kind (exact, wildcard, exception, punycode) of a line of a public suffix list; both null for comments."""
    coded, wild, no = F.regexp_extract(line, r"^// (xn--\S+)", 1), line.rlike(r"^\*\.\S+$"), line.rlike(r"^!\S+$")
    kind = F.when(coded != "", "punycode").when(wild, "wildcard").when(no, "exception").when(~line.startswith("//") & (line != ""), "exact")
    cut = lambda n: F.substring(line, F.lit(n), F.length(line))
    return {"suffix": F.when(coded != "", coded).when(wild, cut(3)).when(no, cut(2)).when(kind.isNotNull(), line), "kind": kind}


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    k = suffix_kind(F.col("line"))
    return lines(spark, path).select(*[c.alias(n) for n, c in k.items()]).where("kind is not null").distinct()


def labelled(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, category (the file's folder), label (benign 0, malicious 1, other -1) and size of files; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
    parts = F.split("path", "/")
    has = lambda name: F.array_contains(parts, name)
    label = F.when(has("benign"), 0).when(has("malicious"), 1).otherwise(-1)
    return f.select("path", F.try_element_at(parts, F.lit(-2)).alias("category"), label.alias("label"), F.col("length").alias("size"))


def report(df: DataFrame, kind: str = "json") -> DataFrame:
    """A text column of each row as JSON or XML."""
    write = {"json": F.to_json, "xml": F.to_xml}[kind]
    return df.select(write(F.struct(*df.columns)).alias("value"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
