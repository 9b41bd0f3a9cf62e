"""Files written here, parsed to tables."""

import zlib

import pytest

from quillmesh.operators import pdf_features as P
from quillmesh.sources import pdf, pdf_filters, pdf_layout, pdf_paths


def a_pdf(links, extra=b""):
    annots = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(links)))
    out = b"%PDF-1.5\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800]>> endobj\n"
    out += b"3 0 obj <</Type /Page /Parent 2 0 R /Annots [" + annots + b"]>> endobj\n"
    for i, uri in enumerate(links):
        out += b"%d 0 obj <</Type /Annot /Subtype /Link /Rect [10 %d 110 %d] /A <</S /URI /URI (%s)>>>> endobj\n" % (10 + i, 10 * i, 10 * i + 8, uri)
    return out + extra + b"trailer <</Root 1 0 R>>\n%%EOF\n"


@pytest.fixture(scope="module")
def pdfs(spark):
    packed = b"50 0 51 30 <</Type /Annot /Subtype /Link>>"
    body = b"50 0 51 9 " + b"(in one) <</JS (x)>>"
    stream = zlib.compress(body)
    objstm = b"40 0 obj <</Type /ObjStm /N 2 /First 10 /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj\n" % (len(stream), stream)
    many = [b"http://a.com/%d.pdf" % i for i in range(6)]
    rows = [
        ("one.pdf", a_pdf([rb"http://a.com/x\(1\).html"])),
        ("many.pdf", a_pdf(many)),
        ("bad.pdf", a_pdf([b"\xff\xfe"])),
        ("versions.pdf", a_pdf([b"http://a.com/1"]) + b"10 0 obj <</Type /Annot /Subtype /Link /Rect [0 0 5 5] /A <</S /URI /URI (http://b.com/2)>>>> endobj\n60 0 obj [1 2 (x)] endobj\n%%EOF\n"),
        ("packed.pdf", a_pdf([], objstm)),
        ("empty.pdf", b""),
        ("junk.pdf", b"<<" * 5000 + b"1 0 obj << /A [ ( endobj"),
        (None, None),
    ]
    assert packed
    return spark.createDataFrame(rows, "path string, content binary").cache()


def test_objects(pdfs):
    rows = pdf.objects(pdfs).collect()
    one = {r.id: r for r in rows if r.path == "one.pdf"}
    assert one[1].tag == "/Catalog" and one[1].refs == [2] and one[3].refs == [2, 10] and one[10].uri == "http://a.com/x(1).html"
    inner = {r.id: r for r in rows if r.path == "packed.pdf" and r.compressed_in == 40}
    assert inner[50].kind == "string" and inner[51].kind == "dictionary"
    assert not [r for r in rows if r.path in ("empty.pdf", None)]


def test_links(pdfs):
    got = pdf.document_links(pdfs).collect()
    one = next(r for r in got if r.path == "one.pdf")
    assert (one.page, one.page_id, one.llx, one.ury, one.media_w, one.media_h, one.in_catalog) == (0, 3, 10.0, 8.0, 600.0, 800.0, True)
    assert [r.uri for r in got if r.path == "bad.pdf"] == ["UnicodeDecodeError"]
    assert [r.uri for r in got if r.path == "versions.pdf"] == ["http://b.com/2"]


def test_features(spark, pdfs):
    links = pdf.document_links(pdfs)
    a = {r.path: r for r in P.aggregate(links).collect()}
    assert a["many.pdf"].tot_num_urls == 6 and a["many.pdf"].n_uris_first_page == 6 and a["many.pdf"].stdev_uris_per_page is None
    assert a["one.pdf"].avg_click_area == 800 and a["one.pdf"].avg_page_area == 480000 and a["one.pdf"].perc_avg_clickable_over_page_area == 0.17
    pages = pdfs.where("path is not null").selectExpr("path", "1 AS n_pages")
    assert {r.path for r in P.is_seo(links, pages).collect() if r.is_seo} == {"many.pdf"}
    o = pdf.objects(pdfs).cache()
    entries = pdf_layout.file_entries(pdfs)
    changes = {(r.version, r.id, r.change) for r in P.change_log(o, entries).where("path = 'versions.pdf'").collect()}
    assert changes == {(1, 10, "modified"), (1, 60, "added"), (1, 10, "mismatch"), (1, 60, "mismatch")}
    assert {(r.path, r.element) for r in P.suspicious(o).collect()} == {("packed.pdf", "/JS")}
    one = pages.withColumn("n_pages", P.F.lit(6))
    assert not P.is_seo(links, one).where("is_seo").collect()
    assert {r.src for r in P.referrers(o, 2).where("path = 'one.pdf'").collect()} == {1, 3}
    assert P.search(o, "b\\.com").count() == 1
    assert {r.path: r.uris for r in P.stats(o).where("version = 0").collect()}["many.pdf"] == 6


def test_binary_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.pdf").write_bytes(a_pdf([b"http://a.com/"]))
    (tmp_path / "y.txt").write_bytes(b"no")
    assert [r.uri for r in pdf.document_links(pdf.files(spark, str(tmp_path))).collect()] == ["http://a.com/"]


def test_filters():
    data = bytes(range(256)) * 3 + b"aaaaaaaaaa"
    import base64

    assert pdf_filters.ascii_hex(data.hex().encode() + b">") == data
    assert pdf_filters.ascii_85(b"<~" + base64.a85encode(data) + b"~>") == data
    assert pdf_filters.inflate(zlib.compress(data)) == data
    assert pdf_filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128])) == b"abczzz"
    assert pdf_filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = [bytes([1, 2, 3]), bytes([4, 6, 9])]
    up = bytes([2]) + rows[0] + bytes([2]) + bytes(b - a for a, b in zip(rows[0], rows[1]))
    assert pdf_filters.predicted(up, {"Predictor": 12, "Columns": 3}) == rows[0] + rows[1]
    sub = bytes([1, 1, 1, 1])
    assert pdf_filters.predicted(sub, {"Predictor": 11, "Columns": 3}) == bytes([1, 2, 3])
    assert pdf_filters.predicted(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])
    assert pdf_filters.decode(b"x", ["Nope"], []) == (b"", ["filter not supported: Nope"])
    assert pdf_filters.decode(b"not flate", ["FlateDecode"], [])[1]


def test_suspicious_and_metadata(spark):
    script = b"var a = util.printf('%45000f', 1); if (a) { return eval(a); } for (;;) { a = a + 1, 2; }"
    font = b"x" * 236 + b"SING" + b"y" * 100
    rows = [
        ("a", 0, 1, "dictionary", b"<< /OpenAction 2 0 R /U3D 1 /AAPL 1 >>", None),
        ("a", 0, 2, "stream", b"<< /Length 9 >>", script),
        ("a", 0, 3, "stream", b"<< /Length 9 >>", font),
        ("a", 0, 4, "stream", b"<< /Length 9 >>", b"AAL/AAAC/wAAAv8A" * 1001),
        ("a", 0, 5, "dictionary", rb"<< /Author (Jo \) Doe) /Producer (old) >>", None),
        ("a", 1, 5, "dictionary", rb"<< /Author (Jo \) Doe) /Producer (new) >>", None),
        ("a", 1, 6, "stream", b"<< /Type /Metadata >>", b"<x:xmpmeta><dc:creator><rdf:Seq><rdf:li>Other</rdf:li></rdf:Seq></dc:creator><xmp:CreatorTool>Tool 1</xmp:CreatorTool></x:xmpmeta>"),
        ("b", 0, 1, "dictionary", b"<< /mailto (x) /AA1 1 >>", None),
    ]
    o = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], "path string, version int, id int, kind string, raw binary, stream binary")
    found = {(r.path, r.kind, r.element): (r.ids, r.cves) for r in P.suspicious(o).collect()}
    assert found == {
        ("a", "event", "/OpenAction"): ([1], []),
        ("a", "element", "/U3D"): ([1], ["CVE-2009-3953", "CVE-2009-3959", "CVE-2011-2462"]),
        ("a", "flaw", "util.printf"): ([2], ["CVE-2008-2992"]),
        ("a", "flaw", "CoolType.SING.uniqueName"): ([3], ["CVE-2010-2883"]),
        ("a", "flaw", "BMP/RLE heap corruption"): ([4], ["CVE-2013-2729"]),
    }
    m = {r.path: r for r in P.metadata(o).collect()}
    assert (m["a"].author, m["a"].creator, m["a"].producer, m["a"].creation) == (r"Jo \) Doe", "Tool 1", "new", None)
    assert m["b"].author is None


def locked(method, revision, password=b""):
    """A file with a link whose target is encrypted, and its expected address."""
    import hashlib

    from quillmesh.sources import pdf_crypt as C

    ident, uri, owner = b"0123456789abcdef", b"http://locked.example/a.pdf", b"O" * 32
    if revision >= 5:
        key, salts = b"k" * 32, b"saltsaltkeykeyke"
        user = C.hardened(password, salts[:8], revision) + salts
        wrapped = C.cbc_encrypt(C.hardened(password, salts[8:], revision), bytes(16), key)
        extra, version = b"/UE <%s>" % wrapped.hex().encode(), 5
    else:
        version, n = {2: (1, 5), 3: (2, 16), 4: (4, 16)}[revision]
        key = hashlib.md5((password + C.PAD)[:32] + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        key, extra = key[:n], b"/Length 128"
        user = C.rc4(key, C.PAD) if revision == 2 else hashlib.md5(C.PAD + ident).digest()
        for i in range(20 if revision > 2 else 0):
            user = C.rc4(bytes(b ^ i for b in key), user)
    own = key if revision >= 5 else hashlib.md5(key + bytes([4, 0, 0, 0, 0]) + (b"sAlT" if method == b"AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
    pad = 16 - len(uri) % 16
    secret = C.rc4(own, uri) if method == b"V2" else b"i" * 16 + C.cbc_encrypt(own, b"i" * 16, uri + bytes([pad]) * pad)
    parts = [b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj", b"2 0 obj <</Type/Pages/Kids[3 0 R]>> endobj", b"3 0 obj <</Type/Page/MediaBox[0 0 9 9]/Annots[4 0 R]>> endobj"]
    parts.append(b"4 0 obj <</Subtype/Link/Rect[0 0 1 1]/A<</S/URI/URI <%s>>>>> endobj" % secret.hex().encode())
    parts.append(b"5 0 obj <</Filter/Standard/V %d/R %d/P -4/O <%s>/U <%s>/CF<</F<</CFM/%s>>>>/StmF/F/StrF/F %s>> endobj" % (version, revision, owner.hex().encode(), user.hex().encode(), method, extra))
    return b"%PDF-1.7\n" + b"\n".join(parts) + b"\ntrailer <</Root 1 0 R/Encrypt 5 0 R/ID[<%s><00>]>>\nstartxref\n0\n%%%%EOF" % ident.hex().encode(), uri.decode()


def test_ciphers():
    """Published vectors of the ciphers."""
    from quillmesh.sources import pdf_crypt as C

    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert C.cbc_encrypt(bytes(range(size)), bytes(16), block).hex() == want
        assert C.cbc_decrypt(bytes(range(size)), bytes(16), bytes.fromhex(want)) == block
    long = bytes(range(256)) * 5
    assert C.cbc_decrypt(b"k" * 16, b"i" * 16, C.cbc_encrypt(b"k" * 16, b"i" * 16, long)) == long
    assert C.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and C.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    assert C.unwrap(b"k" * 16, b"") == C.unwrap(b"k" * 16, b"short") == b""


@pytest.mark.parametrize("method, revision", [(b"V2", 2), (b"V2", 3), (b"V2", 4), (b"AESV2", 4), (b"AESV3", 5), (b"AESV3", 6)])
def test_encrypted_files(method, revision):
    data, uri = locked(method, revision)
    assert [r["uri"] for r in pdf.links(pdf.parse(data))] == [uri]
    data, uri = locked(method, revision, b"secret")
    assert [r["uri"] for r in pdf.links(pdf.parse(data, b"secret"))] == [uri]
    closed = pdf.parse(data)
    assert [r["uri"] for r in pdf.links(closed)] != [uri] and all(r["errors"] == ["password needed"] for r in closed)


def test_layout(spark):
    from quillmesh.sources import pdf_layout as L

    one = b"%PDF-1.4\n1 0 obj <</Type/Catalog>> endobj\n2 0 obj (xref trailer) endobj\n"
    second = one.index(b"2 0 obj")
    one += b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \ntrailer\n<</Root 1 0 R /Info 2 0 R /Size 3 /ID [<6162> <63>]>>\nstartxref\n%d\n%%%%EOF\n" % (9, second + 3, len(one))
    table = zlib.compress(bytes([1, 0, 9, 0, 2, 0, 7, 1, 0, 0, 0, 0]))
    two = one + b"5 0 obj <</Type/XRef /W [1 2 1] /Index [1 2 8 1] /Root 1 0 R /Prev 77 /Size 9 /Encrypt 3 0 R /Filter/FlateDecode>> stream\n" + table + b"\nendstream endobj\nstartxref\n0\n%%EOF"
    rows = [("one", bytearray(one)), ("two", bytearray(two)), ("empty", bytearray()), ("none", None), ("junk", bytearray(b"\xff%PDF xref 1 2 trailer << obj"))]
    d = spark.createDataFrame(rows, "path string, content binary")
    parts = [r for r in L.file_parts(d).collect() if r.path == "two"]
    assert [(r.version, r.part, r.id) for r in parts] == [(0, "header", None), (0, "object", 1), (0, "object", 2), (0, "xref", None), (0, "trailer", None), (0, "startxref", None), (0, "eof", None), (1, "object", 5), (1, "startxref", None), (1, "eof", None)]
    assert all(two[r.start : r.start + r.size].startswith({"object": b"%d 0 obj" % (r.id or 0), "header": b"%PDF", "eof": b"%%EOF"}.get(r.part, r.part.encode())) for r in parts)
    got = [(r.version, r.id, r.kind, r.start, r.holder, r.matches) for r in L.file_entries(d).collect() if r.path == "two"]
    assert got == [(0, 0, "free", None, None, None), (0, 1, "used", 9, None, True), (0, 2, "used", second + 3, None, False), (1, 1, "used", 9, None, True), (1, 2, "compressed", None, 7, None), (1, 8, "free", None, None, None)]
    t = [(r.path, r.version, r.root, r.info, r.size, r.prev, r.encrypted, r.ident and bytes(r.ident), r.hidden) for r in L.file_trailers(d).collect()]
    assert t == [("one", 0, 1, 2, 3, None, False, b"ab", False), ("two", 0, 1, 2, 3, None, False, b"ab", False), ("two", 1, 1, None, 9, 77, True, None, True)]


def test_ways_and_pages(spark):
    """Cycles, two levels of pages, an orphan, a rectangle above its URI, and no catalog."""
    body = b"""%PDF-1.5
1 0 obj <</Type /Catalog /Pages 2 0 R /Outlines 20 0 R>> endobj
2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R] /Count 2>> endobj
3 0 obj <</Type /Pages /Parent 2 0 R /Kids [5 0 R] /MediaBox [0 0 100.4 200]>> endobj
4 0 obj <</Type /Page /Parent 2 0 R /Annots [7 0 R]>> endobj
5 0 obj <</Type /Page /Parent 3 0 R /Annots [6 0 R] /MediaBox [0 0 0 0]>> endobj
6 0 obj <</Type /Annot /Subtype /Link /Rect [1 2 3.5 4] /A 8 0 R>> endobj
7 0 obj <</Type /Annot /Subtype /Link /Rect [1 2 3 4] /A <</S /URI /URI (http://no.box/)>>>> endobj
8 0 obj <</S /URI /URI (http://a\xff/)>> endobj
9 0 obj <</Type /Annot /Rect [0 0 1 1] /A <</URI (http://orphan/)>>>> endobj
20 0 obj <</First 21 0 R>> endobj
21 0 obj <</Next 20 0 R /A <</S /URI /URI (http://outline/)>>>> endobj
"""
    d = spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(body.replace(b"/Catalog", b"/Nothing"))), ("c", None)], "path string, content binary")
    got = {(r.path, r.uri_id): r for r in pdf_paths.uri_facts(d).collect()}
    a = lambda i: got["a", i]
    assert (a(8).way, a(8).mediabox_id, a(8).media_w, a(8).rect_id, a(8).urx, a(8).uri, a(8).is_uri_unicode, a(8).page_id, a(8).tentative_page_num) == ([1, 2, 3, 5, 6, 8], 3, 100.0, 6, 3.5, "UnicodeDecodeError", False, 5, 1)
    assert (a(7).is_in_catalog_path, a(7).rect_id, a(7).has_annot, a(9).way, a(9).rect_id, a(21).has_annot) == (False, 7, True, [], 9, False)
    assert all(not r.is_in_catalog_path and r.mediabox_id is None for (p, _), r in got.items() if p == "b") and {p for p, _ in got} == {"a", "b"}
    assert [(r.page, r.page_id, r.depth, r.media_w, r.own_box, r.n_pages, r.counted) for r in pdf_paths.page_tree(d).orderBy("page").collect()] == [(0, 5, 2, 0.0, True, 2, True), (1, 4, 1, None, False, 2, True)]
    chain = b"1 0 obj <</Type /Catalog /N 2 0 R /MediaBox [0 0 1 1] /Annots 1>> endobj\n" + b"".join(b"%d 0 obj <</N %d 0 R>> endobj\n" % (i, i + 1) for i in range(2, 3000)) + b"3000 0 obj <</URI (x)>> endobj"
    assert len(pdf_paths.facts(pdf.parse(chain))[0]["way"]) == 3000


def test_changes_by_versions(spark):
    """Removed objects come back as added; what is free elsewhere changes nothing."""
    o = spark.createDataFrame([("a", v, i) for v, i in [(0, 1), (0, 2), (1, 2), (2, 1), (3, 1)]], "path string, version int, id int")
    e = spark.createDataFrame([("a", v, i, k) for v, i, k in [(1, 1, "free"), (1, 2, "used"), (2, 1, "used"), (2, 2, "used"), (3, 1, "used"), (3, 1, "free"), (3, 9, "free")]], "path string, version int, id int, kind string")
    got = sorted((r.version, r.id, r.change) for r in P.change_log(o, e).collect())
    assert got == [(1, 1, "removed"), (1, 2, "modified"), (2, 1, "added"), (2, 2, "mismatch"), (3, 1, "mismatch"), (3, 1, "modified")]
