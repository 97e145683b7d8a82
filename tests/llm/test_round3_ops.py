"""Vector groups, periodic runs and Merkle proofs against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from terraframe.llm import components, merkle, pigeonhole, queries, recompression, runs


def brute_links(rows, cosine):
    """rows of (id, vector, label): links of each row by position, and the smallest id of its component."""
    fine = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(v, float) / max(abs(np.array(v, float))) for v in (rows[i][1], rows[j][1]))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    parent[root(i)] = root(j)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[root(i)] = min(lowest.get(root(i), r[0]), r[0])
    return sorted(((r[0], n[i], lowest.get(root(i)), r[0] == lowest.get(root(i))) for i, r in enumerate(rows)), key=str)


def clustered(seed, n, dim, spread=0.1, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20 + 1, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = []
    for i in range(n):
        v = centres[int(rng.integers(len(centres)))] + rng.normal(size=dim) * spread * rng.random() / math.sqrt(dim)
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([0.5, 1.0, 3.0])], int(rng.integers(labels))))
    return out


@pytest.mark.parametrize(("dim", "side", "leaf"), [(64, 2048, 16), (64, 16, 4), (10, 8, 2), (3, 8, 2), (1, 50, 4)])
def test_vector_groups_match_brute_force(spark, monkeypatch, dim, side, leaf):
    monkeypatch.setattr(pigeonhole, "SIDE", side)
    monkeypatch.setattr(pigeonhole, "FIT_LEAF", leaf)
    rows = clustered(dim, 240, dim, 0.3)
    got = pigeonhole.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = brute_links(rows, 0.98)
    assert sum(r[1] for r in want) > 50
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_vector_groups_odd(spark):
    v = [3.0, 4.0, 0.0]
    rows = [(i, v, 1) for i in range(5)] + [(None, v, 1), (7, v, None), (8, None, 1), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 2.0], 1), (12, [1.0, float("nan"), 2.0], 1), (13, [1.0, float("inf"), 2.0], 1)]
    rows += [(14, [6e200, 8e200, 0.0], 1), (15, [6e-200, 8e-200, -0.0], 1), (16, v, 2), (17, [3.0, 4.0], 1), (18, [3.0, 4.01], 1), (3, [0.0, 0.0, 9.0], 2), (3, v, 2), (None, [0.0, 7.0, 1.0], 4), (None, [0.0, 7.0, 1.0], 4)]
    schema = "vec_id long, embedding array<double>, label int, n_links string, comp long, node string"
    got = pigeonhole.near_groups(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(a, b, c, (a == c)) for a, b, c, _ in brute_links(rows, 0.98)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert pigeonhole.near_groups(spark.createDataFrame([], schema)).count() == 0
    assert pigeonhole.deduplicate(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)).columns == ["vec_id", "embedding", "label", "n_links", "comp", "node"]


def test_turning_keeps_distances():
    units = pigeonhole.unit(np.random.default_rng(1).normal(size=(50, 37)))
    turned = pigeonhole.rotated(units)
    assert np.allclose(turned @ turned.T, units @ units.T)
    assert (pigeonhole.rotated(units[7:9]) == turned[7:9]).all()


def test_hub_of_links(spark):
    """No row gathers the links of a hub, whichever end it is."""
    star = spark.range(1, 100_001)
    for u, v in (("id", "0"), ("id", "200000")):
        edges = star.selectExpr(f"cast({u} AS long) AS u", f"cast({v} AS long) AS v")
        got = components.components(edges)
        assert got.selectExpr("count(*)", "max(comp)", "min(comp)").first()[:] == (100_001, int(v == "200000"), int(v == "200000"))


def test_vector_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.queries()["op11_pigeonhole"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, 0.98)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold_up(nodes):
    """The root of nodes, and for each the siblings level by level as (left, right)."""
    paths = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for lo in range(0, len(nodes), 8):
            run = nodes[lo : lo + 8]
            for k in range(len(run)):
                for i in held[lo + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            over.append([i for h in held[lo : lo + 8] for i in h])
        nodes, held = up, over
    return nodes[0], paths


def brute_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text): the contract's rows, ties by leaf."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    made = [(r[2], r[0], sha(*map(told, r)), sha(*map(told, (*r[:4], low(r[4])))) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else None) for r in rows]
    made.sort(key=lambda m: (m[0] is not None, (m[0] or "").encode(), m[1] is not None, m[1] or 0, m[2]))
    langs = list(dict.fromkeys(m[0] for m in made))
    trees = [fold_up([m[2] for m in made if m[0] == g]) for g in langs]
    root, above = fold_up([t[0] for t in trees])
    out = []
    for g, (subroot, inner), over in zip(langs, trees, above):
        for m, path in zip([m for m in made if m[0] == g], inner):
            folded = m[3] or m[2]
            for left, right in path + over:
                folded = sha(left, folded, right)
            out.append((m[1], m[2], subroot, root, sha(*[x for step in path + over for x in step]), folded, folded == root))
    return sorted(out, key=str)


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("n", "langs"), [(700, 3), (90, 40), (1, 1), (9, 1)])
def test_manifest_matches_brute_force(spark, n, langs):
    rng = random.Random(n)
    ids = rng.sample(range(-10**6 if n == 700 else 0, 10**6 if n == 90 else 1000), n)
    rows = [(i, rng.choice(["a", None, "ß"]), f"l{rng.randrange(langs)}", rng.choice([None, 3]), rng.choice(["Ab é", "plain", None, ""])) for i in ids]
    if n > 500:
        rows += [(None, "s", "l0", 1, "Nobody")] * 20 + [(5, "s", "l1", 1, f"Same {k % 4}") for k in range(30)] + [(6, "s", None, 1, "T"), (10**15, "s", "l0", 1, "Far"), (-(2**63), "s", "l2", 1, "Low"), (2**63 - 1, "s", "l2", 1, "High")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string, leaf int").repartition(3)
    got = merkle.manifest(docs).select(*RESULT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0


def test_manifest_query(spark, sf):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.queries()["op13_merkle"](spark, sf)
    assert got.columns == RESULT
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def wavy(rng):
    """Words with repetitions inside repetitions, and some luck."""
    words = [rng.choice("abc") for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        base = words[-rng.randrange(1, 12) :] or ["z"]
        words += base * rng.randrange(1, 14) + [rng.choice("abcd") for _ in range(rng.randrange(9))]
    return words


def test_runs_match_brute_force():
    rng = random.Random(12)
    docs = [wavy(rng) for _ in range(400)] + [["a"] * k for k in (0, 1, 23, 24, 25, 500)] + [list("ab") * 40 + list("ba") * 40]
    ids = {w: k for k, w in enumerate("abcdz")}
    flat = np.array([ids[w] for d in docs for w in d])
    got = runs.runs_of(flat, np.array([len(d) for d in docs]))
    want = [brute_runs(d) for d in docs]
    assert [sorted(map(tuple, g.tolist())) for g in got] == want
    assert sum(map(len, want)) > 300


def test_grammar_extensions():
    rng = random.Random(3)
    docs = [wavy(rng) for _ in range(30)]
    docs = [d for d in docs if len(d) > 1]
    sizes = np.array([len(d) for d in docs])
    grammar = recompression.Grammar(np.array([ord(w) for d in docs for w in d]), sizes)
    asked = [(k, *rng.sample(range(len(docs[k])), 2)) for k in range(len(docs)) for _ in range(200)]
    for step in (1, -1):
        i, j = (np.array([grammar.at[a[0]] + a[c] for a in asked]) for c in (1, 2))
        got = grammar.extend(i, j, step)
        for (k, x, y), n in zip(asked, got.tolist()):
            d, want = docs[k], 0
            while 0 <= min(x, y) and max(x, y) < len(d) and d[x] == d[y]:
                x, y, want = x + step, y + step, want + 1
            assert n == want


def brute_run_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, sha(*[f"{s},{length},{q}\n" for s, length, q in found]), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_query(spark, sf, tmp_path):
    rng = random.Random(8)
    odd = [None, "", " \t\n", "a" * 5000, " ".join(["x y"] * 400), "\x0b".join("Zz\x1c\u2003é") + "\x0c" * 30, " ".join(wavy(rng)) + "\r\n" + "q " * 3000]
    rows = [(i, t) for i, t in enumerate(odd * 12)] + [(None, "n " * 90), (3, "r s t " * 30), (3, "r s t " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs").write.parquet(f"{tmp_path}/documents.parquet")
    for where in (str(tmp_path), sf):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
        got = queries.queries()["op12_runs"](spark, where)
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((brute_run_row(*d) for d in docs), key=str)
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_pigeonhole", "op13_merkle"])
def test_queries_match_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
