"""Tables derived from parsed PDF files: edges, change logs, suspicious elements, link features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.reports import looks_like_script


def newest(objects: DataFrame) -> DataFrame:
    """The newest version of each object."""
    rest = [c for c in objects.columns if c not in ("path", "id")]
    return objects.groupBy("path", "id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("path", "id", "r.*")


def edges(objects: DataFrame) -> DataFrame:
    return newest(objects).select("path", F.col("id").alias("src"), F.explode("refs").alias("dst"))


def referrers(objects: DataFrame, target: int) -> DataFrame:
    return edges(objects).where(F.col("dst") == target).select("path", "src")


def search(objects: DataFrame, pattern: str) -> DataFrame:
    """Objects whose raw or decoded bytes match, whatever the case."""
    match = lambda c: F.decode(c, "ISO-8859-1").rlike(f"(?i){pattern}")
    return objects.where(match(F.col("raw")) | F.coalesce(match(F.col("stream")), F.lit(False))).select("path", "version", "id")


def change_log(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """What each later version does to objects: added, modified (written again), removed, or mismatch.

    entries are cross-reference entries (path, version, id, kind). An object is removed where a version's entries free it and
    the version has it not. mismatch: it is written and not listed as used, or listed as free; or it is known, not written,
    and listed as used. One pass over each object's versions in order.
    """
    from pyspark.sql import Window

    written = objects.select("path", "id", "version", F.lit("written").alias("what"))
    listed = entries.where("kind IN ('used', 'free', 'compressed')").select("path", "id", "version", F.when(F.col("kind") == "free", "free").otherwise("used").alias("what"))
    each = written.unionByName(listed).groupBy("path", "id", "version").agg(*[F.bool_or(F.col("what") == w).alias(w) for w in ("written", "used", "free")])
    # the newest state before: known if it was written last, gone if it was freed; what is only listed as used changes nothing
    state = F.when(F.col("written"), F.lit(True)).when(F.col("free"), F.lit(False))
    before = F.last(state, ignorenulls=True).over(Window.partitionBy("path", "id").orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    known = F.coalesce(before, F.lit(False))
    change = F.when(F.col("written"), F.when(F.col("known"), "modified").otherwise("added")).when(F.col("known") & F.col("free"), "removed")
    odd = F.when(F.col("written"), ~F.col("used") | F.col("free")).otherwise(F.col("known") & F.col("used"))
    both = F.array_compact(F.array(change, F.when(odd, F.lit("mismatch"))))
    return each.withColumn("known", known).where("version > 0").select("path", "version", "id", F.explode(both).alias("change"))


#: What can act on a reader, by kind. A name that ends in a blank is a whole name.
EVENTS = ("/OpenAction ", "/AA ", "/Names ", "/AcroForm ", "/XFA ")
ACTIONS = ("/JS ", "/JavaScript", "/Launch", "/SubmitForm", "/ImportData")
ELEMENTS = ("/EmbeddedFiles ", "/EmbeddedFile", "/JBIG2Decode", "getPageNthWord", "arguments.callee", "/U3D", "/PRC", "/RichMedia", "/Flash", ".rawValue", "keep.previous")
SCRIPT_FLAWS = ("mailto", "Collab.collectEmailInfo", "util.printf", "getAnnots", "getIcon", "spell.customDictionaryOpen", "media.newPlayer", "doc.printSeps", "app.removeToolButton")
FONT_NAME, BITMAP_FLAW = "CoolType.SING.uniqueName", "BMP/RLE heap corruption"
#: The known flaws of an element.
FLAWS = {
    "mailto": ("CVE-2007-5020",),
    "Collab.collectEmailInfo": ("CVE-2007-5659",),
    "util.printf": ("CVE-2008-2992",),
    "/JBIG2Decode": ("CVE-2009-0658",),
    "getIcon": ("CVE-2009-0927",),
    "getAnnots": ("CVE-2009-1492",),
    "spell.customDictionaryOpen": ("CVE-2009-1493",),
    "media.newPlayer": ("CVE-2009-4324",),
    ".rawValue": ("CVE-2010-0188",),
    FONT_NAME: ("CVE-2010-2883",),
    "doc.printSeps": ("CVE-2010-4091",),
    "/U3D": ("CVE-2009-3953", "CVE-2009-3959", "CVE-2011-2462"),
    "/PRC": ("CVE-2011-4369",),
    "keep.previous": ("CVE-2013-0640",),
    BITMAP_FLAW: ("CVE-2013-2729",),
    "app.removeToolButton": ("CVE-2013-3346",),
}
#: Where a font's stream has its table's tag and the end of a name, and what the other flaw's stream repeats.
FONT_AT, FONT_TAG, FONT_END, BITMAP_TEXT, BITMAP_TIMES = 236, "SING", 327, "AAL/AAAC/wAAAv8A", 1000


def suspicious(objects: DataFrame) -> DataFrame:
    """Object ids that have each element, with its kind and known flaws, by file and version; one pass, no join.

    Events, actions and elements are sought in an object's own text, script flaws where the object or its stream is a script.
    """
    text, body = F.decode("raw", "ISO-8859-1"), F.coalesce(F.decode("stream", "ISO-8859-1"), F.lit(""))
    script = looks_like_script(body) | text.rlike(r"/JS(?![A-Za-z0-9])")
    hit = lambda kind, name, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(name.strip()).alias("element"), F.array(*map(F.lit, FLAWS.get(name, ()))).cast("array<string>").alias("cves")))
    has = lambda name: text.rlike(rf"{name.strip()}(?![A-Za-z0-9])") if name.endswith(" ") else text.contains(name)
    font = (F.length(body) > FONT_END) & (F.substring(body, FONT_AT + 1, 4) == FONT_TAG) & (F.substring(body, FONT_END + 1, 1) != "\0")
    bitmap = (F.length(body) - F.length(F.replace(body, F.lit(BITMAP_TEXT), F.lit("")))) / len(BITMAP_TEXT) > BITMAP_TIMES
    named = [hit(kind, n, has(n)) for kind, names in (("event", EVENTS), ("action", ACTIONS), ("element", ELEMENTS)) for n in names]
    flaws = [hit("flaw", n, script & (text.contains(n) | body.contains(n))) for n in SCRIPT_FLAWS] + [hit("flaw", FONT_NAME, font), hit("flaw", BITMAP_FLAW, ~font & bitmap)]
    found = objects.select("path", "version", "id", F.explode(F.array_compact(F.array(*named, *flaws))).alias("x"))
    return found.groupBy("path", "version", "x.kind", "x.element", "x.cves").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def metadata(objects: DataFrame) -> DataFrame:
    """author, creator, producer, creation and modification of each file: those of its information dictionary, else of its XMP packet."""
    text, body = F.decode("raw", "ISO-8859-1"), F.decode("stream", "ISO-8859-1")
    plain = F.col("kind") == "dictionary"
    own = lambda name: F.max_by(F.nullif(F.regexp_extract(text, rf"(?s)/{name}\s*\(((?:[^()\\]|\\.)*)\)", 1), F.lit("")), F.when(plain & text.rlike(rf"/{name}\s*\("), F.col("version")))
    tag = lambda name: F.min(F.nullif(F.trim(F.regexp_extract(body, rf"(?s)<{name}(?:\s[^>]*)?>(?:\s|<rdf:[^>]*>)*([^<]*)", 1)), F.lit("")))
    pick = lambda key, *tags: F.coalesce(own(key), *[tag(t) for t in tags])
    return objects.groupBy("path").agg(
        pick("Author", "dc:creator").alias("author"),
        pick("Creator", "xap:CreatorTool", "xmp:CreatorTool").alias("creator"),
        pick("Producer", "pdf:Producer").alias("producer"),
        pick("CreationDate", "xap:CreateDate", "xmp:CreateDate").alias("creation"),
        pick("ModDate", "xap:ModifyDate", "xmp:ModifyDate").alias("modification"),
    )


def stats(objects: DataFrame) -> DataFrame:
    """Counts of a file's objects, streams, URIs, scripts and errors by version."""
    return objects.groupBy("path", "version").agg(F.count("*").alias("objects"), F.count_if(F.col("kind") == "stream").alias("streams"), F.count_if(F.col("uri").isNotNull()).alias("uris"), F.count_if(F.decode("raw", "ISO-8859-1").contains("/JS")).alias("scripts"), F.sum(F.size("errors")).alias("errors"), F.count_if(F.col("compressed_in").isNotNull()).alias("compressed"))


def object_facts(objects: DataFrame) -> DataFrame:
    """Digests, sizes and marks of each object: what it is, what it refers to, whether it has a script, and its action."""
    raw = F.decode("raw", "ISO-8859-1")
    name = lambda key: F.nullif(F.regexp_extract(raw, rf"/{key}\s*/([^\s/<>\[\]()]+)", 1), F.lit(""))
    script = raw.rlike(r"/JS(?![A-Za-z0-9])") | F.coalesce(looks_like_script(F.decode("stream", "ISO-8859-1")), F.lit(False))
    return objects.select("path", "version", "id", "kind", "tag", "compressed_in", F.md5("raw").alias("md5"), F.sha1("raw").alias("sha1"), F.md5("stream").alias("stream_md5"), F.length("raw").alias("size"), "refs", F.size("refs").alias("n_refs"), script.alias("has_script"), name("Subtype").alias("subtype"), name("S").alias("action"), F.col("uri"), F.size("errors").alias("n_errors"))


def errors(objects: DataFrame) -> DataFrame:
    """One row for each error of an object."""
    return objects.select("path", "version", "id", F.explode("errors").alias("error"))


def tree(objects: DataFrame) -> DataFrame:
    """path, version, id, tag and refs: the logical tree of each version; an object without a tag is named by its kind."""
    return objects.select("path", "version", "id", F.coalesce("tag", "kind").alias("tag"), "refs")


def dot(objects: DataFrame) -> DataFrame:
    """Each file's graph of newest objects as text in the dot language, nodes and edges in order."""
    o = newest(objects)
    nodes = F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(' [label="'), F.col("id").cast("string"), F.lit(" "), F.coalesce("tag", "kind"), F.lit('"];'))
    arrows = F.transform("refs", lambda r: F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" -> "), r.cast("string"), F.lit(";")))
    lines = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(F.array(nodes), arrows).alias("l")))), lambda x: x["l"])), "\n")
    return o.groupBy("path").agg(F.concat(F.lit("digraph {\n"), lines, F.lit("\n}")).alias("dot"))


def has_area(llx: Column, lly: Column, urx: Column, ury: Column) -> Column:
    """Whether a rectangle is there and isn't empty."""
    return F.coalesce((llx != urx) & (lly != ury), F.lit(False))


def clickable_areas(facts: DataFrame, image_w: Column, image_h: Column) -> DataFrame:
    """facts (of pdf_paths.uri_facts) with each URI's rectangle on the page's image, and its area.

    Vertices are rounded, scaled by image over media box and rounded again, half to even; the image's y begins at the top.
    Without a rectangle or a media box, all are null and clickable_area_gt_zero is false.
    """
    at = lambda v, image, media: F.bround(F.bround(v, 0) * image / media, 0)
    x0, x1 = at(F.col("llx"), image_w, F.col("media_w")), at(F.col("urx"), image_w, F.col("media_w"))
    y0, y1 = image_h - at(F.col("lly"), image_h, F.col("media_h")), image_h - at(F.col("ury"), image_h, F.col("media_h"))
    area = F.abs(x1 - x0) * F.abs(y0 - y1)
    return facts.select("*", x0.alias("left"), y1.alias("top"), x1.alias("right"), y0.alias("bottom"), area.alias("clickable_area"), F.coalesce(area > 0, F.lit(False)).alias("clickable_area_gt_zero"))


def geometry(links: DataFrame) -> DataFrame:
    """links with the clickable area and the page's area."""
    w, h = F.abs(F.col("urx") - F.col("llx")), F.abs(F.col("ury") - F.col("lly"))
    return links.withColumn("clickable_area", F.bround(w, 0) * F.bround(h, 0)).withColumn("mediabox_area", F.col("media_w") * F.col("media_h"))


def aggregate(links: DataFrame) -> DataFrame:
    """Link and area features of each file; per_page lists each page's links and their mean area."""
    g = geometry(links)
    pages = g.where(F.col("page").isNotNull()).groupBy("path", "page").agg(F.count("*").alias("n"), F.avg("clickable_area").alias("area"), F.first("media_w").alias("w"), F.first("media_h").alias("h"))
    by_page = pages.groupBy("path").agg(F.bround(F.avg("n"), 2).alias("avg_uris_per_page"), F.bround(F.stddev_samp("n"), 2).alias("stdev_uris_per_page"), F.array_sort(F.collect_list(F.struct("page", "n", "area"))).alias("per_page"))
    sizes = pages.select("path", "w", "h").distinct().groupBy("path").agg(F.bround(F.avg(F.col("w") * F.col("h")), 2).alias("avg_page_area"))
    whole = g.groupBy("path").agg(F.count("*").alias("tot_num_urls"), F.countDistinct("uri").alias("num_unique_urls"), F.count_if(F.col("uri") == "UnicodeDecodeError").alias("num_unparsable_urls"), F.count_if(F.col("page") == 0).alias("n_uris_first_page"), F.bround(F.avg("clickable_area"), 2).alias("avg_click_area"))
    out = whole.join(by_page, "path", "left").join(sizes, "path", "left")
    return out.withColumn("perc_avg_clickable_over_page_area", F.bround(F.col("avg_click_area") / F.col("avg_page_area") * 100, 2))


def is_seo(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a file has five links to PDF files or more, and more such links than pages (path, n_pages)."""
    n = links.groupBy("path").agg(F.count_if(F.col("uri").contains(".pdf") & F.col("page").isNotNull()).alias("pdf"))
    return pages.join(n, "path", "left").select("path", F.coalesce((F.col("pdf") >= 5) & (F.col("pdf") > F.col("n_pages")), F.lit(False)).alias("is_seo"))
