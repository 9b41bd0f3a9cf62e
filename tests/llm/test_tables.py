"""Manifest, vectors and quantiles against brute force and DuckDB, on planted and awkward rows."""

import bisect
import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("quillmesh.llm")
from quillmesh.llm import gridjoin, manifest, oracle, quantiles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_manifest", "op12_vectors", "op13_quantiles"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    cur = c.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


# -- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The top, and each leaf's siblings before and after it, level by level."""
    level, under, path = list(nodes), [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(level) > 1:
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for j in range(len(run)):
                for leaf in under[at + j]:
                    path[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
        under = [sum(under[at : at + 3], []) for at in range(0, len(level), 3)]
        level = [H(*level[at : at + 3]) for at in range(0, len(level), 3)]
    return level[0], path


def brute_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(told, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, over = brute_tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (subroot, below), above in zip(names, trees, over):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), below):
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf(r, r.text.replace("\n", "") if even and r.text is not None else r.text)
            for before, after in path + above:
                node = H(before, node, after)
            out.append((r.doc_id, own, subroot, root, H(*[a + b for a, b in path + above]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, storey", [(7, 2), (2, 1), (3, 3), (1, 2)])
def test_manifest(spark, levels, storey, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "STOREY", storey)
    rows = [(i, f"a{i}\nb\n" if i % 3 else f"c{i}", "en", "hot", i) for i in range(100)]
    rows += [(200 + i, "x\ny", None, f"s{i}", None) for i in range(30)] + [(300 + i, "x\ny", None, "three", None) for i in range(3)]
    rows += [(None, "t\n", "en", None, 1), (500, None, "en", None, 1), (501, "", "en", "", 1), (502, "é\n" * 1000, "fr", "ünï", 3), (503, "dup\n", "en", "z", 1), (503, "dup\n", "en", "z", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("x", "g")
    for c in ("g", "pos", "node", "leaf", "path", "block"):
        d = d.selectExpr("*", f"'other' AS {c}")
    got = manifest.document_manifest(d).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(d.collect())
    assert manifest.document_manifest(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 26, 27])
def test_traversal_is_bounded(n):
    leaves = [H(str(i)).encode() for i in range(n)]
    levels = manifest.levels_of(n, 0)
    root, want = brute_tree([x.decode() for x in leaves])
    assert [[(a.decode(), b.decode()) for a, b in p] for p in manifest.paths(leaves, levels)] == want
    assert manifest.top_of(leaves, levels).decode() == root


# -- vectors


def brute_vectors(rows, limit=0.93):
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [i for i, (k, v, g) in enumerate(rows) if k is not None and g is not None and fit(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = {i: np.array(rows[i][1], float) / np.abs(np.array(rows[i][1], float)).max() for i in ok}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] / np.sqrt((u[a] @ u[a]) * (u[b] @ u[b])) >= limit:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((k, links[i], least[find(i)] if i in u else k, k == (least[find(i)] if i in u else k)) for i, (k, _, _) in enumerate(rows)), key=repr)


def planted(rng, noise=150, dims=16):
    rows = [(i, rng.normal(size=dims).tolist(), int(i % 2)) for i in range(noise)]
    for c in range(4):  # clusters of several widths, exact and scaled copies among them
        center = rng.normal(size=dims)
        for j in range(60):
            rows.append((1000 + 100 * c + j, (center * (1 + j % 3) + rng.normal(size=dims) * (0, 0.01, 0.2, 0.35)[c]).tolist(), 1))
    rows += [(i, rows[0][1], 0) for i in range(3000, 3040)]
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    rows = planted(np.random.default_rng(3))
    for kind in ("double", "float"):
        typed = [(k, np.array(v, np.float32).astype(float).tolist() if kind == "float" else v, g) for k, v, g in rows]
        d = spark.createDataFrame(typed, f"vec_id long, embedding array<{kind}>, label int").repartition(5)
        got = gridjoin.near_vectors(d).collect()
        assert sorted(map(tuple, got), key=repr) == brute_vectors(typed)


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    same = [1.0, 2.0, 3.0]
    rows = [(1, same, "a"), (2, same, "a"), (2, same, "a"), (3, same, None), (4, None, "a"), (5, [], "a"), (6, [0.0, 0.0, 0.0], "a"), (7, [1.0, None, 3.0], "a"), (8, [1.0, inf, 3.0], "a"), (9, [1.0, nan, 3.0], "a")]
    rows += [(10, same, "b"), (11, [1.0, 2.0], "a"), (12, [2.0, 4.0], "a"), (None, same, "a"), (13, [1e300, 2e300, 3e300], "a"), (14, [1e-300, 2e-300, 3e-300], "a"), (15, [-1.0, -2.0, -3.0], "a"), (16, [-0.0, 0.0, 5.0], "a"), (17, [0.0, 0.0, 1.0], "a")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for c in ("g", "rep", "k", "number", "cells", "h1", "id"):
        d = d.selectExpr("*", f"'other' AS {c}")
    got = sorted(map(tuple, gridjoin.near_vectors(d).collect()), key=repr)
    want = [(k, n, c, True if k is None else kept) for k, n, c, kept in brute_vectors(rows)]
    assert got == sorted(want, key=repr)
    assert gridjoin.near_vectors(d.limit(0)).count() == 0
    assert gridjoin.near_vectors(d.where("vec_id in (4, 5)")).count() == 2


def test_dense_groups_are_counted_as_wholes(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 8)
    rng = np.random.default_rng(1)
    center = rng.normal(size=8)
    rows = [(i, (center + rng.normal(size=8) * 1e-3).tolist(), 1) for i in range(400)]
    seen = []
    real = gridjoin.joined_blocks
    monkeypatch.setattr(gridjoin, "joined_blocks", lambda c: seen.append(c) or real(c))
    names = []
    cut = gridjoin.materialise
    monkeypatch.setattr(gridjoin, "materialise", lambda df, name: names.append((name, out := cut(df, name))) or out)
    got = gridjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}
    assert sum(df.where("NOT near").count() for name, df in names if name == "intervals") == 0  # no pair of vectors was looked at


# -- quantiles


def brute_ranks(values, x):
    s = sorted(values)
    return bisect.bisect_left(s, x), bisect.bisect_right(s, x)


@pytest.mark.parametrize("kind", ["even", "heavy", "few", "wide"])
def test_points_have_exact_ranks(spark, kind):
    rng = np.random.default_rng(4)
    values = {"even": rng.integers(0, 5000, 4000), "heavy": np.concatenate([np.full(5000, 77), rng.integers(-100, 9000, 90)]), "few": rng.integers(0, 3, 100), "wide": (rng.pareto(0.3, 3000) * 100).clip(max=1e15).astype(int)}[kind].tolist()
    d = spark.createDataFrame([("k", v) for v in values], "key string, x long")
    points = quantiles.summarise(d, ["key"]).collect()
    least = min(4, len(set(values)))
    assert least <= len(points) <= 49 and min(values) in {p.x for p in points} and max(values) in {p.x for p in points}
    assert all((p.most, p.least) == brute_ranks(values, p.x) and p.n == len(values) for p in points)
    n = len(values)
    for a in quantiles.answers(spark.createDataFrame(points), ["key"]).collect():
        below, upto = brute_ranks(values, a.answer)
        assert below < a.target <= upto and a.target == -(-a.i * n // 10)


def test_merges_keep_their_bounds(spark):
    rng = np.random.default_rng(8)
    parts = {(g, b): rng.integers(0, 1000, int(rng.integers(1, 900))) * (b + 1) for g in "xy" for b in range(12)}
    d = spark.createDataFrame([(g, b, int(v)) for (g, b), vs in parts.items() for v in vs], "g string, b int, x long")
    own = quantiles.summarise(d, ["g", "b"])
    halves = quantiles.merge(own.selectExpr("g", "b % 3 AS third", "b", "x", "least", "most", "n", "full"), ["g", "third", "b"], ["g", "third"])
    short = quantiles.compress(halves, ["g", "third"], 60)
    assert max(r["count"] for r in short.groupBy("g", "third").count().collect()) <= 60
    for merged, error in ((quantiles.merge(own, ["g", "b"], ["g"]), 0.03), (quantiles.merge(short, ["g", "third"], ["g"]), 0.08)):
        merged = merged.collect()
        for g in "xy":
            values = np.concatenate([v for k, v in parts.items() if k[0] == g]).tolist()
            for p in (p for p in merged if p.g == g):
                below, upto = brute_ranks(values, p.x)
                assert p.n == len(values) and below <= p.most and p.least <= upto
            asked = [r for r in quantiles.answers(spark.createDataFrame(merged), ["g"]).collect() if r.g == g]
            assert len(asked) == 9 and [r.answer for r in sorted(asked, key=lambda r: r.i)] == sorted(r.answer for r in asked)
            for r in asked:
                below, upto = brute_ranks(values, r.answer)
                assert max(0, below + 1 - r.target, r.target - upto) <= error * len(values)


def test_odd_streams(spark):
    clicks = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, None, 2.0), (3, 5, None), (None, 5, 3.0), (4, 5, float("nan")), (5, 5, float("inf")), (6, 5, -0.005)], "click_id long, client_id long, value double").selectExpr("*", "'o' AS grp", "1 AS x", "2 AS batch")
    lines = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 3), (9, 3), (3, 3)], "item_id long, vendor_id long").selectExpr("*", "1 AS w")
    items = spark.createDataFrame([(1, "b", 2.5), (1, "b", 9.5), (2, "b", 1.0), (3, None, 1.0)], "item_id long, brand string, price double").selectExpr("*", "1 AS r")
    batch = lambda i: zlib.crc32(str(i).encode()) % 8
    got = sorted(map(tuple, quantiles.streams(clicks, lines, items).select("stream", "grp", "batch", "x", "w").collect()))
    assert got == sorted([("value", "5", batch(1), 100 + 1000 * batch(1), 1), ("value", "5", 0, 300, 1), ("value", "5", batch(6), 1000 * batch(6), 1), ("price", "b", batch(1), 250 + 1000 * batch(1), 2), ("price", "b", 0, 100, 1)])
    assert quantiles.quantile_report(quantiles.streams(clicks.limit(0), lines.limit(0), items)).count() == 0
