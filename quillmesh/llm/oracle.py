"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from . import gridjoin, licenses, manifest, quantiles
from .linededup import SITES
from .quality import DEFAULT_STRENGTH, LONG_WORD, MARGIN, SHORT_WORD, SURE, WORDS_A_DUP_LINE, WORDS_A_SYMBOL

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
), s AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) JOIN rare USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP4 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
tri AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, sum(c - 1) AS c FROM (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY doc_id),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.c, 0)::BIGINT AS n_dup_lines, coalesce(hit.c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {WORDS_A_SYMBOL} * n_symbols > n_words
    OR word_chars < {SHORT_WORD} * n_words OR word_chars > {LONG_WORD} * n_words OR {WORDS_A_DUP_LINE} * n_dup_lines > n_words AS failed FROM base),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n) AS total, sum(n * n) AS squares, sum(k * k / n) AS second FROM h),
b AS (SELECT *, mean * (1 - mean) AS noise, CASE WHEN total - squares / total > 0 THEN (second - mean * mean * total - (hosts - 1) * mean * (1 - mean)) / (total - squares / total) END AS between_ FROM m),
prior AS (SELECT coalesce(mean, 0) AS mean, greatest(CASE WHEN between_ > 0 AND noise > between_ THEN noise / between_ - 1 ELSE {DEFAULT_STRENGTH} END, 1) AS strength FROM b),
post AS (SELECT source, mean, (k + mean * strength) / (n + strength) AS rate, n + strength AS weight FROM h, prior),
bad AS (SELECT source FROM post WHERE rate - {SURE} * sqrt(rate * (1 - rate) / (weight + 1)) > mean + {MARGIN})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), keys AS (SELECT DISTINCT k, g FROM win), sizes AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (SELECT doc_id, k, i, g FROM dw JOIN keys USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN win USING (k, g)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE text IS NOT NULL)),
spread AS (SELECT line, count(DISTINCT source) AS s FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING s >= {SITES}),
marked AS (SELECT l.*, spread.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, i) > 1 AS gone FROM l LEFT JOIN spread USING (line)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept.text, ''))::BIGINT AS chars_left, md5(coalesce(kept.text, '')) AS left_md5
FROM d LEFT JOIN kept USING (doc_id)
"""

_TEMPLATES = " UNION ALL ".join("SELECT '{}' AS license_id, '{}' AS text".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

OP7 = rf"""
WITH t AS (SELECT license_id, {_WORDS} AS w FROM ({_TEMPLATES})),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ts AS (SELECT DISTINCT license_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT license_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
tn AS (SELECT license_id, count(*) AS m FROM ts GROUP BY license_id),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
f AS (SELECT doc_id, license_id, count(DISTINCT g) AS n_found, min(p) AS first_word FROM ds JOIN ts USING (g) GROUP BY 1, 2)
SELECT doc_id, license_id, m::BIGINT AS n_shingles, n_found::BIGINT AS n_found, first_word::BIGINT AS first_word
FROM f JOIN tn USING (license_id) WHERE 100 * n_found >= {licenses.CONTAINMENT_PERCENT} * m
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _tree(name: str, levels: int) -> str:
    """CTEs of the nodes of each level above {name}0 (g, pos, node, n), and of each node's siblings; as many levels as given."""
    a, out = manifest.ARITY, []
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, pos // {a} AS run, list(node ORDER BY pos) AS run_nodes, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, run AS pos, sha256(array_to_string(run_nodes, '')) AS node, (n + {a - 1}) // {a} AS n FROM {name}r{k})")
    joins = " ".join(f"LEFT JOIN {name}r{k} ON {name}r{k}.g = {name}0.g AND {name}r{k}.run = {name}0.pos // {a ** (k + 1)}" for k in range(levels))
    at = [f"({name}0.pos // {a**k} % {a})" for k in range(levels)]
    steps = ", ".join(f"CASE WHEN {name}r{k}.g IS NOT NULL THEN {{'before': array_to_string({name}r{k}.run_nodes[:{at[k]}], ''), 'after': array_to_string({name}r{k}.run_nodes[{at[k]} + 2:], '')}} END" for k in range(levels))
    out.append(f"{name}p AS MATERIALIZED (SELECT {name}0.*, list_filter([{steps}], lambda s: s IS NOT NULL) AS path FROM {name}0 {joins})")
    out.append(f"{name}t AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, node AS top FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    return ",\n".join(out)


def _told(*columns: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns) + "))"


_RECORD = ("doc_id", "source", "lang", "n_chars")

#: Levels that are written out suffice for 3 ** 12 documents of a source and 3 ** 8 sources.
OP11 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce('s' || source, '') AS g, {_told(*_RECORD, "text")} AS node,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_told(*_RECORD, "replace(text, chr(10), '')")} END AS met FROM documents
), m0 AS MATERIALIZED (SELECT doc_id, g, node, met, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("m", 12)},
b0 AS MATERIALIZED (SELECT mt.g AS source, '' AS g, top AS node, row_number() OVER (ORDER BY encode(mt.g)) - 1 AS pos, count(*) OVER () AS n FROM mt),
{_tree("b", 8)},
proven AS (SELECT a.doc_id, a.node AS leaf, a.met, b.node AS subroot, bt.top AS root, list_concat(a.path, b.path) AS path FROM mp a JOIN bp b ON b.source = a.g, bt),
met AS (SELECT *, list_reduce(list_prepend({{'before': '', 'after': coalesce(met, leaf)}}, path), lambda x, s: {{'before': '', 'after': sha256(concat(s.before, x.after, s.after))}}).after AS folded_root FROM proven)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.before || s.after), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM met
"""

OP12 = f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {gridjoin.COSINE}),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

_CENTS = "floor(100 * {} + 0.5)::BIGINT + 1000 * batch AS x"

OP13 = rf"""
WITH once AS (SELECT DISTINCT click_id, client_id, value FROM clicks),
v AS (SELECT client_id::VARCHAR AS grp, {_crc32("click_id::VARCHAR")} % {quantiles.BATCHES} AS batch, value FROM once WHERE client_id IS NOT NULL AND value IS NOT NULL),
vendor AS MATERIALIZED (SELECT vendor_id, {_crc32("vendor_id::VARCHAR")} % {quantiles.BATCHES} AS batch FROM (SELECT DISTINCT vendor_id FROM sale_lines)),
p AS (SELECT brand AS grp, batch, price FROM sale_lines JOIN items USING (item_id) JOIN vendor USING (vendor_id) WHERE brand IS NOT NULL AND price IS NOT NULL),
x AS (SELECT 'value' AS stream, grp, batch, {_CENTS.format("value")} FROM v UNION ALL SELECT 'price', grp, batch, {_CENTS.format("price")} FROM p),
c AS MATERIALIZED (SELECT stream, grp, batch, x, count(*) AS w FROM x GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY stream, grp, batch ORDER BY x) AS least, sum(w) OVER (PARTITION BY stream, grp, batch) AS n, row_number() OVER (PARTITION BY stream, grp, batch ORDER BY x) AS k, count(*) OVER (PARTITION BY stream, grp, batch) AS d FROM c),
own AS MATERIALIZED (
  SELECT stream, grp, batch, x, least, least - w AS most, n FROM r
  WHERE d <= {quantiles.KEEP} OR k = 1 OR least * {quantiles.CUTS} // n > (least - w) * {quantiles.CUTS} // n OR k * {quantiles.SPREAD} // d > (k - 1) * {quantiles.SPREAD} // d
), spot AS (SELECT DISTINCT stream, grp, x FROM own),
bounds AS (
  SELECT spot.stream, spot.grp, spot.x, o.batch, coalesce(max(o.least) FILTER (o.x <= spot.x), 0) AS least, coalesce(min(o.most) FILTER (o.x >= spot.x), any_value(o.n)) AS most, any_value(o.n) AS n
  FROM spot JOIN own o USING (stream, grp) GROUP BY ALL
), both_ AS (SELECT * FROM own UNION ALL SELECT stream, grp, -1, x, sum(least), sum(most), sum(n) FROM bounds GROUP BY stream, grp, x),
s AS MATERIALIZED (SELECT *, count(*) OVER w AS points, lag(x) OVER o AS x_before, coalesce(lag(least) OVER o, 0) AS reached FROM both_ WINDOW w AS (PARTITION BY stream, grp, batch), o AS (PARTITION BY stream, grp, batch ORDER BY x)),
q AS (SELECT DISTINCT stream, grp, batch, n, points, i, (i * n + {quantiles.PARTS - 1}) // {quantiles.PARTS} AS target FROM s, range(1, {quantiles.PARTS}) AS t(i) WHERE n >= {quantiles.LEAST_ROWS}),
a AS MATERIALIZED (
  SELECT q.*, CASE WHEN x_before IS NOT NULL AND target - reached < most + 1 - target THEN x_before ELSE x END AS answer
  FROM q JOIN s USING (stream, grp, batch) WHERE reached < target AND target <= least
), every_ AS MATERIALIZED (SELECT * FROM c UNION ALL SELECT stream, grp, -1, x, sum(w) FROM c GROUP BY stream, grp, x),
e AS (SELECT *, sum(w) OVER (PARTITION BY stream, grp, batch ORDER BY x) AS upto FROM every_),
told AS (
  SELECT a.stream, a.grp, a.batch, a.i, any_value(a.n) AS n, any_value(a.target) AS target, min(e.x) FILTER (e.upto >= a.target) AS exact_x, any_value(a.points) AS points, any_value(a.answer) AS answer,
    coalesce(sum(e.w) FILTER (e.x < a.answer), 0) AS n_below, coalesce(sum(e.w) FILTER (e.x <= a.answer), 0) AS n_upto
  FROM a JOIN e ON e.stream = a.stream AND e.grp = a.grp AND e.batch = a.batch GROUP BY a.stream, a.grp, a.batch, a.i
), f AS (SELECT *, greatest(0, n_below + 1 - target, target - n_upto) AS rank_error FROM told)
SELECT stream, grp, batch::INT AS batch, i::INT AS i, n::BIGINT AS n, target::BIGINT AS target, exact_x, points::BIGINT AS points, answer, n_below::BIGINT AS n_below, n_upto::BIGINT AS n_upto, rank_error::BIGINT AS rank_error, 1000 * rank_error <= 50 * n AS within FROM f
"""

ORACLE_SQL = {
    "op1_minhash": OP1,
    "op4_quality": OP4,
    "op5_decontaminate": OP5,
    "op6_lines": OP6,
    "op7_licenses": OP7,
    "op11_manifest": OP11,
    "op12_vectors": OP12,
    "op13_quantiles": OP13,
}
