"""PDF files as tables. The files are written from pages, deterministically, so that every answer follows from a page's row.

A file has a catalog, a page tree with two links a page, information, streams, an action, an array of annotations, an object
stream, cross-references and, for even pages, a second version. Which of these a file has depends on its page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import url as U
from quillmesh.operators import pdf_features as P
from quillmesh.operators import resolve
from quillmesh.operators.storage import cut
from quillmesh.sources import pdf, pdf_layout, pdf_paths

from .registry import query, table
from .url_queries import _HREFS

PER_PAGE = 2
IMAGE = 1200, 1600


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _object(id, *body) -> Column:
    return _text(id, " 0 obj ", *body, " endobj\n")


def written(spark, sf_dir: str) -> DataFrame:
    """path (the page's id) and content of one file for each page."""
    i, escape = F.col("page_id"), lambda c: F.regexp_replace(c, r"([()\\])", r"\\$1")
    every = lambda n, c: F.when(i % n == 0, c).otherwise(F.lit(""))
    target = lambda j: escape(F.concat(F.get("h", j), every(5, F.lit(".pdf"))))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    d = table(spark, sf_dir, "pages").select("page_id", "url", U.hrefs(F.col("html")).alias("h")).withColumn("n", F.size("h")).withColumn("k", F.ceil(F.col("n") / PER_PAGE).cast("int"))
    kids = F.array_join(F.transform(numbers(F.col("k")), lambda p: _text(p + 100, " 0 R")), " ")

    def page(p: Column) -> Column:
        own = F.filter(numbers(F.col("n")), lambda j: F.floor(j / PER_PAGE) == p)
        box = F.when(p % 2 == 1, "/MediaBox [0 0 300 400] ").otherwise("")
        extra = F.when((p == 0) & (i % 4 == 0), "/Extra 6 0 R ").otherwise("")
        return _object(p + 100, "<</Type /Page /Parent 2 0 R ", box, extra, "/Annots [", F.array_join(F.transform(own, lambda j: _text(j + 1000, " 0 R")), " "), "]>>")

    def annotation(j: Column) -> Column:
        rect = _text("<</Type /Annot /Subtype /Link /Rect [10 ", j * 10, " 110.5 ", j * 10 + 8, "] /A ")
        direct = _object(j + 1000, rect, "<</S /URI /URI (", target(j), ")>>>>")
        by_action = F.concat(_object(j + 1000, rect, _text(j + 2000, " 0 R>>")), _object(j + 2000, "<</S /URI /URI (", target(j), ")>>"))
        return F.when(j % 5 == 4, by_action).otherwise(direct)

    code = F.hex(F.col("url").cast("binary"))
    link = lambda rect, uri: _text("<</Type /Annot /Subtype /Link /Rect [", rect, "] /A <</S /URI /URI (", uri, ")>>>>")
    first = F.concat(
        F.lit("%PDF-1.5\n"),
        _object("1", "<</Type /Catalog /Pages 2 0 R", every(3, F.lit(" /OpenAction 5 0 R")), ">>"),
        _object("2", "<</Type /Pages /Kids [", kids, "] /Count ", F.col("k"), " /MediaBox [0 0 600 800]>>"),
        _object("3", "<</Author (Author ", i, ") /Producer (Writer ", i % 4, ") /CreationDate (D:20240101)>>"),
        _object("4", "<</Length ", F.length(code) + 1, " /Filter /ASCIIHexDecode>> stream\n", code, ">\nendstream"),
        every(3, _object("5", "<</S /JavaScript /JS (app.alert\\(", i, "\\);)>>")),
        every(4, _object("6", "[", link("0 0 50 20", escape(F.col("url"))), " ", link("0 0 0 20", escape(F.concat("url", F.lit("#again")))), "]")),
        _object("7", "<</Type /ObjStm /N 2 /First 10 /Length 28>> stream\n50 0 51 9 (in one) <</K 1>>\nendstream"),
        F.array_join(F.transform(numbers(F.col("k")), page), ""),
        F.array_join(F.transform(numbers(F.col("n")), annotation), ""),
        F.lit("xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \n"),
        _text("trailer <</Root 1 0 R /Info 3 0 R /Size 2000 /ID [<0", i % 10, "> <01>]>>\nstartxref\n0\n%%EOF\n"),
    )
    second = F.concat(
        _object("1000", link("20 0 40 30", escape(F.col("url")))),
        _object("60", "[1 2]"),
        F.lit("xref\n3 2\n0000000000 00000 n \n0000000000 00001 f \n60 1\n0000000000 00000 n \ntrailer <</Root 1 0 R /Prev 9 /Size 2001>>\nstartxref\n0\n%%EOF\n"),
    )
    return d.select(F.col("page_id").cast("string").alias("path"), F.concat(first, every(2, second)).cast("binary").alias("content"))


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("page_id_", F.col("path").cast("long")).drop("path").withColumnRenamed("page_id_", "doc")


# the objects of all files, as they are written: doc, version, id, kind, tag, refs, uri, holder, body
_Q = r"'([()\\])', '\\\1', 'g'"
_OBJECTS = rf"""{_HREFS}, l AS (SELECT page_id AS i, site, pos::INT AS j, href || CASE WHEN page_id % 5 = 0 THEN '.pdf' ELSE '' END AS t FROM h),
d AS (SELECT page_id AS i, any_value(site) AS url, count(*) AS n, ceil(count(*) / {PER_PAGE})::INT AS k FROM h GROUP BY 1), g AS (SELECT i, k, n, unnest(range(0, k))::INT AS p FROM d),
e AS (SELECT *, '<</Type /Annot /Subtype /Link /Rect [10 ' || j * 10 || ' 110.5 ' || (j * 10 + 8) || '] /A ' AS head, '<</S /URI /URI (' || regexp_replace(t, {_Q}) || ')>>' AS act FROM l),
w AS (SELECT *, '<</Type /Annot /Subtype /Link /Rect [0 0 50 20] /A <</S /URI /URI (' || regexp_replace(url, {_Q}) || ')>>>>' AS one, '<</Type /Annot /Subtype /Link /Rect [0 0 0 20] /A <</S /URI /URI (' || regexp_replace(url || '#again', {_Q}) || ')>>>>' AS two,
  '<</Type /Annot /Subtype /Link /Rect [20 0 40 30] /A <</S /URI /URI (' || regexp_replace(url, {_Q}) || ')>>>>' AS again FROM d),
o AS (
SELECT i AS doc, 0 AS version, 1 AS id, 'dictionary' AS kind, '/Catalog' AS tag, CASE WHEN i % 3 = 0 THEN [2, 5] ELSE [2] END AS refs, NULL AS uri, NULL::INT AS holder, '<</Type /Catalog /Pages 2 0 R' || CASE WHEN i % 3 = 0 THEN ' /OpenAction 5 0 R' ELSE '' END || '>>' AS body FROM d
UNION ALL SELECT i, 0, 2, 'dictionary', '/Pages', range(100, 100 + k)::INT[], NULL, NULL, '<</Type /Pages /Kids [' || array_to_string(list_transform(range(100, 100 + k), lambda x: x || ' 0 R'), ' ') || '] /Count ' || k || ' /MediaBox [0 0 600 800]>>' FROM d
UNION ALL SELECT i, 0, 3, 'dictionary', NULL, []::INT[], NULL, NULL, '<</Author (Author ' || i || ') /Producer (Writer ' || i % 4 || ') /CreationDate (D:20240101)>>' FROM d
UNION ALL SELECT i, 0, 4, 'stream', NULL, [], NULL, NULL, '<</Length ' || (length(hex(encode(url))) + 1) || ' /Filter /ASCIIHexDecode>> stream' || chr(10) || hex(encode(url)) || '>' || chr(10) || 'endstream' FROM d
UNION ALL SELECT i, 0, 5, 'dictionary', '/Action /JavaScript', [], NULL, NULL, '<</S /JavaScript /JS (app.alert\(' || i || '\);)>>' FROM d WHERE i % 3 = 0
UNION ALL SELECT i, 0, 6, 'array', NULL, [], NULL, NULL, '[' || one || ' ' || two || ']' FROM w WHERE i % 4 = 0
UNION ALL SELECT i, 0, 7, 'stream', '/ObjStm', [], NULL, NULL, '<</Type /ObjStm /N 2 /First 10 /Length 28>> stream' || chr(10) || '50 0 51 9 (in one) <</K 1>>' || chr(10) || 'endstream' FROM d
UNION ALL SELECT i, 0, 50, 'string', NULL, [], NULL, 7, '(in one)' FROM d
UNION ALL SELECT i, 0, 51, 'dictionary', NULL, [], NULL, 7, '<</K 1>>' FROM d
UNION ALL SELECT i, 0, 100 + p, 'dictionary', '/Page', list_sort(list_concat(CASE WHEN p = 0 AND i % 4 = 0 THEN [2, 6] ELSE [2] END, range(1000 + {PER_PAGE} * p, 1000 + least({PER_PAGE} * p + {PER_PAGE}, n))::INT[])), NULL, NULL,
  '<</Type /Page /Parent 2 0 R ' || CASE WHEN p % 2 = 1 THEN '/MediaBox [0 0 300 400] ' ELSE '' END || CASE WHEN p = 0 AND i % 4 = 0 THEN '/Extra 6 0 R ' ELSE '' END || '/Annots [' || array_to_string(list_transform(range(1000 + {PER_PAGE} * p, 1000 + least({PER_PAGE} * p + {PER_PAGE}, n)), lambda x: x || ' 0 R'), ' ') || ']>>' FROM g
UNION ALL SELECT i, 0, 1000 + j, 'dictionary', '/Annot', CASE WHEN j % 5 = 4 THEN [2000 + j] ELSE [] END, CASE WHEN j % 5 <> 4 THEN t END, NULL, head || CASE WHEN j % 5 = 4 THEN (2000 + j) || ' 0 R>>' ELSE act || '>>' END FROM e
UNION ALL SELECT i, 0, 2000 + j, 'dictionary', '/Action /URI', [], t, NULL, act FROM e WHERE j % 5 = 4
UNION ALL SELECT i, 1, 1000, 'dictionary', '/Annot', [], url, NULL, again FROM w WHERE i % 2 = 0
UNION ALL SELECT i, 1, 60, 'array', NULL, [], NULL, NULL, '[1 2]' FROM d WHERE i % 2 = 0),
newest AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY version DESC) = 1),
links AS (SELECT doc, id - 1000 AS j, version, CASE WHEN uri IS NULL THEN (SELECT t FROM l WHERE l.i = doc AND l.j = id - 1000) ELSE uri END AS uri, ((id - 1000) // {PER_PAGE})::INT AS page FROM newest WHERE id BETWEEN 1000 AND 1999)"""


@query(f"WITH {_OBJECTS} SELECT doc, version, id, kind, tag, array_to_string(refs, ',') AS refs, uri, holder AS compressed_in, md5(body) AS md5, sha1(body) AS sha1, CASE id WHEN 4 THEN md5((SELECT url FROM d WHERE d.i = doc)) WHEN 7 THEN md5('50 0 51 9 (in one) <</K 1>>') END AS stream_md5, strlen(body) AS size, len(refs) AS n_refs, id = 5 AS has_script, CASE WHEN tag = '/Annot' OR id = 6 THEN 'Link' END AS subtype, CASE WHEN id = 5 THEN 'JavaScript' WHEN uri IS NOT NULL OR id = 6 THEN 'URI' END AS action, 0 AS n_errors FROM o")
def pdf_objects(spark, sf_dir):
    """Every object of every version of the files, with digests, references and marks."""
    facts = P.object_facts(pdf.objects(written(spark, sf_dir)))
    return _id(facts.withColumn("refs", F.array_join("refs", ",")).withColumn("size", F.col("size").cast("long")).withColumn("n_refs", F.col("n_refs").cast("long")))


@query(f"WITH {_OBJECTS} SELECT doc, version, part, count(*) AS n FROM (SELECT doc, version, 'object' AS part FROM o WHERE holder IS NULL UNION ALL SELECT doc, version, unnest(CASE version WHEN 0 THEN ['header', 'xref', 'trailer', 'startxref', 'eof'] ELSE ['xref', 'trailer', 'startxref', 'eof'] END) FROM (SELECT DISTINCT doc, version FROM o)) GROUP BY ALL")
def pdf_parts(spark, sf_dir):
    """How many parts of each kind each version has."""
    return _id(pdf_layout.file_parts(written(spark, sf_dir)).groupBy("path", "version", "part").agg(F.count("*").alias("n")))


@query(f"""WITH {_OBJECTS}, b AS (SELECT doc, id, version, strlen(id || ' 0 obj ' || body || ' endobj') AS size, row_number() OVER (PARTITION BY doc, version ORDER BY CASE WHEN id >= 1000 THEN (id % 1000) * 2 + id // 2000 + 1000 ELSE id END) AS r FROM o WHERE holder IS NULL AND version = 0)
SELECT doc, id, 9 + coalesce(sum(size + 1) OVER (PARTITION BY doc ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, size FROM b""")
def pdf_offsets(spark, sf_dir):
    """Where each object of the first version begins, and its length in bytes."""
    p = pdf_layout.file_parts(written(spark, sf_dir)).where("part = 'object' AND version = 0")
    return _id(p.select("path", "id", "start", "size"))


@query("""WITH d AS (SELECT page_id AS doc FROM pages) SELECT doc, version, id, generation, kind, start::BIGINT AS start, matches FROM d, (VALUES (0, 0, 65535, 'free', NULL, NULL), (0, 1, 0, 'used', 9, true), (1, 3, 0, 'used', 0, false), (1, 4, 1, 'free', NULL, NULL), (1, 60, 0, 'used', 0, false)) t(version, id, generation, kind, start, matches) WHERE version = 0 OR doc % 2 = 0""")
def pdf_entries(spark, sf_dir):
    """Cross-reference entries, and whether an object begins where one says."""
    return _id(pdf_layout.file_entries(written(spark, sf_dir)).drop("holder"))


@query("""WITH d AS (SELECT page_id AS doc FROM pages) SELECT doc, 0 AS version, 1 AS root, 3 AS info, 2000 AS size, NULL::BIGINT AS prev, '0' || doc % 10 AS ident, false AS encrypted FROM d UNION ALL SELECT doc, 1, 1, NULL, 2001, 9, NULL, false FROM d WHERE doc % 2 = 0""")
def pdf_trailers(spark, sf_dir):
    """What each version's trailer names."""
    t = pdf_layout.file_trailers(written(spark, sf_dir))
    return _id(t.select("path", "version", "root", "info", "size", "prev", F.hex("ident").alias("ident"), "encrypted"))


@query(f"WITH {_OBJECTS} SELECT doc, version, id, coalesce(tag, kind) AS tag, array_to_string(refs, ',') AS refs FROM o")
def pdf_tree(spark, sf_dir):
    """The logical tree of each version."""
    return _id(P.tree(pdf.objects(written(spark, sf_dir))).withColumn("refs", F.array_join("refs", ",")))


@query(f"WITH {_OBJECTS} SELECT doc, unnest(refs) AS dst, id AS src FROM newest")
def pdf_edges(spark, sf_dir):
    """References of the newest objects; whatever refers to an object is found by its other end."""
    return _id(P.edges(pdf.objects(written(spark, sf_dir))))


@query(f"""WITH RECURSIVE {_OBJECTS}, edge AS (SELECT doc, id AS src, unnest(refs) AS dst FROM newest), root AS (SELECT doc, id FROM newest WHERE tag = '/Catalog'),
walk(doc, node, way) AS (SELECT doc, id, [id] FROM root UNION ALL SELECT w.doc, e.dst, list_append(w.way, e.dst) FROM walk w JOIN edge e ON e.doc = w.doc AND e.src = w.node WHERE NOT list_contains(w.way, e.dst))
SELECT doc, node, len(w) - 1 AS depth, array_to_string(w, ' ') AS way FROM (SELECT doc, node, min_by(way, (len(way), way)) AS w FROM walk GROUP BY 1, 2)""")
def pdf_ways(spark, sf_dir):
    """The first shortest way from each file's catalog to each object, by one search over all files' graphs."""
    objects = cut(P.newest(pdf.objects(written(spark, sf_dir))), "objects")
    roots = objects.where("tag = '/Catalog'").select(F.col("path").alias("doc"), F.col("id").alias("node"))
    edges = objects.select(F.col("path").alias("doc"), F.col("id").alias("src"), F.explode("refs").alias("dst"))
    found = resolve.ways(edges, roots).withColumnRenamed("doc", "path")
    return _id(found.withColumn("way", F.array_join("way", " ")))


@query(f"WITH {_OBJECTS}, x AS (SELECT doc, list(id || ' [label=\"' || id || ' ' || coalesce(tag, kind) || '\"];' || array_to_string(list_transform(refs, lambda r: '{chr(10)}  ' || id || ' -> ' || r || ';'), '') ORDER BY id) AS a FROM newest GROUP BY 1) SELECT doc, md5('digraph {{{chr(10)}  ' || array_to_string(a, '{chr(10)}  ') || '{chr(10)}}}') AS dot FROM x")
def pdf_graph(spark, sf_dir):
    """Each file's graph in the dot language, as its digest."""
    return _id(P.dot(pdf.objects(written(spark, sf_dir))).withColumn("dot", F.md5(F.col("dot").cast("binary"))))


@query(f"WITH {_OBJECTS} SELECT doc, version, id FROM o WHERE contains(lower(body), '.com') OR (id = 4 AND contains((SELECT lower(url) FROM d WHERE d.i = doc), '.com'))")
def pdf_search(spark, sf_dir):
    """Objects that have a string in their text or decoded stream, whatever the case."""
    return _id(P.search(pdf.objects(written(spark, sf_dir)), r"\.COM"))


@query(f"WITH {_OBJECTS} SELECT doc, p AS page, 100 + p AS page_id, 1 AS depth, CASE WHEN p % 2 = 1 THEN 300 ELSE 600 END::DOUBLE AS media_w, CASE WHEN p % 2 = 1 THEN 400 ELSE 800 END::DOUBLE AS media_h, p % 2 = 1 AS own_box, k AS n_pages, true AS counted FROM (SELECT i AS doc, k, p FROM g)")
def pdf_pages(spark, sf_dir):
    """The leaves of the page tree with the media box that holds for them."""
    return _id(pdf_paths.page_tree(written(spark, sf_dir)))


_BOX = "CASE WHEN page % 2 = 1 THEN 300 ELSE 600 END::DOUBLE AS media_w, CASE WHEN page % 2 = 1 THEN 400 ELSE 800 END::DOUBLE AS media_h"


@query(f"WITH {_OBJECTS} SELECT doc, uri, 1000 + j AS object_id, 100 + page AS page_id, page, CASE version WHEN 1 THEN 20 ELSE 10 END::DOUBLE AS llx, CASE version WHEN 1 THEN 0 ELSE j * 10 END::DOUBLE AS lly, CASE version WHEN 1 THEN 40 ELSE 110.5 END::DOUBLE AS urx, CASE version WHEN 1 THEN 30 ELSE j * 10 + 8 END::DOUBLE AS ury, {_BOX}, true AS in_catalog FROM links")
def pdf_links(spark, sf_dir):
    """Link annotations with their page, rectangle and media box."""
    return _id(pdf.document_links(written(spark, sf_dir)))


_FACTS = f"""f AS (SELECT doc, uri, CASE WHEN j % 5 = 4 THEN 2000 + j ELSE 1000 + j END AS uri_id, 1000 + j AS rect_id, CASE WHEN j % 5 = 4 THEN [1, 2, 100 + page, 1000 + j, 2000 + j] ELSE [1, 2, 100 + page, 1000 + j] END AS way, page,
  CASE version WHEN 1 THEN 20 ELSE 10 END::DOUBLE AS llx, CASE version WHEN 1 THEN 0 ELSE j * 10 END::DOUBLE AS lly, CASE version WHEN 1 THEN 40 ELSE 110.5 END::DOUBLE AS urx, CASE version WHEN 1 THEN 30 ELSE j * 10 + 8 END::DOUBLE AS ury FROM links
UNION ALL SELECT i, url || CASE WHEN c = 1 THEN '#again' ELSE '' END, 6, 6, [1, 2, 100, 6], 0, 0, 0, CASE WHEN c = 1 THEN 0 ELSE 50 END, 20 FROM d, (VALUES (0), (1)) t(c) WHERE i % 4 = 0)"""


@query(f"WITH {_OBJECTS}, {_FACTS} SELECT doc, uri, uri_id, rect_id, array_to_string(way, '>') AS way, true AS is_in_catalog_path, CASE WHEN page % 2 = 1 THEN 100 + page ELSE 2 END AS mediabox_id, {_BOX}, 100 + page AS page_id, page + 1 AS tentative_page_num, true AS has_annot, true AS is_uri_unicode, llx, lly, urx, ury FROM f")
def pdf_uri_facts(spark, sf_dir):
    """Each URI's way from the catalog, the object with its rectangle, its media box and its page."""
    return _id(pdf_paths.uri_facts(written(spark, sf_dir)).withColumn("way", F.array_join("way", ">")))


@query(f"""WITH {_OBJECTS}, {_FACTS}, m AS (SELECT *, {_BOX} FROM f),
r AS (SELECT doc, uri_id, uri, round_even(round_even(llx, 0) * {IMAGE[0]} / media_w, 0) AS "left", {IMAGE[1]} - round_even(round_even(ury, 0) * {IMAGE[1]} / media_h, 0) AS top, round_even(round_even(urx, 0) * {IMAGE[0]} / media_w, 0) AS "right", {IMAGE[1]} - round_even(round_even(lly, 0) * {IMAGE[1]} / media_h, 0) AS bottom, llx <> urx AND lly <> ury AS has_area FROM m)
SELECT *, abs("right" - "left") * abs(bottom - top) AS clickable_area, abs("right" - "left") * abs(bottom - top) > 0 AS clickable_area_gt_zero FROM r""")
def pdf_clickable_areas(spark, sf_dir):
    """Rectangles on an image of the page, and their areas."""
    a = P.clickable_areas(pdf_paths.uri_facts(written(spark, sf_dir)), F.lit(float(IMAGE[0])), F.lit(float(IMAGE[1])))
    area = P.has_area(*[F.col(c) for c in ("llx", "lly", "urx", "ury")])
    return _id(a.select("path", "uri_id", "uri", "left", "top", "right", "bottom", area.alias("has_area"), "clickable_area", "clickable_area_gt_zero"))


@query(f"WITH {_OBJECTS} SELECT doc, version, id, 0 AS pos, uri FROM o WHERE uri IS NOT NULL UNION ALL SELECT i, 0, 6, c, url || CASE WHEN c = 1 THEN '#again' ELSE '' END FROM d, (VALUES (0), (1)) t(c) WHERE i % 4 = 0")
def pdf_byte_uris(spark, sf_dir):
    """URIs found by objects' bytes alone."""
    return _id(pdf_paths.byte_uris(pdf.objects(written(spark, sf_dir))))


@query(f"""WITH {_OBJECTS}, c AS (SELECT doc, page, count(*) AS n, avg(CASE version WHEN 1 THEN 600 ELSE 800 END) AS area FROM links GROUP BY 1, 2), s AS (SELECT DISTINCT doc, page % 2 AS odd FROM links),
t AS (SELECT doc, count(*) AS tot_num_urls, count(DISTINCT uri) AS num_unique_urls, count(*) FILTER (uri = 'UnicodeDecodeError') AS num_unparsable_urls, count(*) FILTER (page = 0) AS n_uris_first_page, round_even(avg(CASE version WHEN 1 THEN 600 ELSE 800 END), 2) AS avg_click_area FROM links GROUP BY 1),
a AS (SELECT doc, round_even(avg(CASE odd WHEN 1 THEN 120000 ELSE 480000 END), 2) AS avg_page_area FROM s GROUP BY 1), b AS (SELECT doc, round_even(avg(n), 2) AS avg_uris_per_page, round_even(stddev_samp(n), 2) AS stdev_uris_per_page, string_agg(page || ':' || n || ':' || area, ',' ORDER BY page) AS per_page FROM c GROUP BY 1)
SELECT *, round_even(avg_click_area / avg_page_area * 100, 2) AS perc_avg_clickable_over_page_area FROM t JOIN a USING (doc) JOIN b USING (doc)""")
def pdf_document_features(spark, sf_dir):
    """Counts of links and areas of each file and of its pages."""
    a = P.aggregate(pdf.document_links(written(spark, sf_dir)))
    listed = F.array_join(F.transform("per_page", lambda x: F.concat_ws(":", x["page"].cast("string"), x["n"].cast("string"), x["area"].cast("string"))), ",")
    return _id(a.withColumn("per_page", listed))


@query(f"WITH {_OBJECTS}, c AS (SELECT doc, count(*) FILTER (contains(uri, '.pdf')) AS n FROM links GROUP BY 1) SELECT doc, c.n >= 5 AND c.n > k AS is_seo FROM c JOIN d ON i = doc")
def pdf_is_seo(spark, sf_dir):
    """Files with five links to PDF files or more, and more of them than pages."""
    files = written(spark, sf_dir)
    n = pdf_paths.page_tree(files).groupBy("path").agg(F.max("n_pages").alias("n_pages"))
    return _id(P.is_seo(pdf.document_links(files), n))


@query(f"WITH {_OBJECTS} SELECT doc, 1 AS version, id, change FROM (SELECT i AS doc FROM d WHERE i % 2 = 0), (VALUES (1000, 'modified'), (1000, 'mismatch'), (60, 'added'), (4, 'removed'), (3, 'mismatch')) t(id, change)")
def pdf_changes(spark, sf_dir):
    """What the second versions add, modify and remove, and where their entries say otherwise."""
    files = written(spark, sf_dir)
    return _id(P.change_log(pdf.objects(files), pdf_layout.file_entries(files)))


@query("SELECT page_id AS doc, 'Author ' || page_id AS author, NULL::VARCHAR AS creator, 'Writer ' || page_id % 4 AS producer, 'D:20240101' AS creation, NULL::VARCHAR AS modification FROM pages")
def pdf_metadata(spark, sf_dir):
    return _id(P.metadata(pdf.objects(written(spark, sf_dir))))


@query("SELECT page_id AS doc, 0 AS version, kind, element, '' AS cves, ids FROM pages, (VALUES ('event', '/OpenAction', '1'), ('action', '/JS', '5'), ('action', '/JavaScript', '5')) t(kind, element, ids) WHERE page_id % 3 = 0")
def pdf_suspicious(spark, sf_dir):
    """Objects that can act on a reader, by file and element."""
    s = P.suspicious(pdf.objects(written(spark, sf_dir)))
    return _id(s.withColumn("ids", F.array_join("ids", ",")).withColumn("cves", F.array_join("cves", ",")))


@query(f"WITH {_OBJECTS} SELECT doc, version, count(*) AS objects, count(*) FILTER (kind = 'stream') AS streams, count(uri) AS uris, count(*) FILTER (id = 5) AS scripts, 0::BIGINT AS errors, count(holder) AS compressed FROM o GROUP BY 1, 2")
def pdf_stats(spark, sf_dir):
    """Counts of each version's objects, streams, URIs, scripts and errors."""
    return _id(P.stats(pdf.objects(written(spark, sf_dir))))
