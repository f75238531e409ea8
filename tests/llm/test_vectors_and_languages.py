"""Centroids, whitening and language profiles against brute force."""

import hashlib
import math
import os
import zlib

import numpy as np
import pytest

from ledgerline.llm import centroids, language_id, queries, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<float>"
MESSY = "vec_id string, embedding array<float>, `q` string, `cluster` int, `a.b` int, digest string, n long"


def integers(v):
    return [math.floor(256 * float(x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_centroids(rows, k, rounds, dim):
    """(vec_id, cluster, distance, centroid) with plain integers; rows: (vec_id, vector)."""
    kept = [(i, integers(v)) for i, v in rows if usable(v) and len(v) == dim]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in first[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in set(of):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(q)[1], near(q)[0], cents[near(q)[1]]) for i, q in kept]


def check_centroids(got, rows, k, rounds, dim):
    want = brute_centroids(rows, k, rounds, dim)
    inertia = {}
    for _, c, d, _ in want:
        inertia[c] = inertia.get(c, 0) + d
    full = [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent)).encode()).hexdigest()) for i, c, d, cent in want]
    order = lambda r: (r[0] is None, str(r[0]), r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(full, key=order)


def some_vectors(n, dim, seed, kinds=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds, dim)) / 4
    return [(i, [float(np.float32(x)) for x in base[rng.integers(kinds)] + rng.normal(size=dim) / 40 * rng.integers(0, 2)]) for i in range(n)]


def test_centroids_are_exact(spark):
    """Copies of a third of all rows, ties, repeated and null ids, unusable vectors."""
    rows = some_vectors(240, 8, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(120)] + [rows[5]] * 3 + [(None, rows[9][1]), (None, [0.5] * 8)]
    bad = [(-1, None), (-2, []), (-3, [1.0] * 7), (-4, [float("nan")] + [0.0] * 7), (-5, [None] + [0.0] * 7), (-6, [float("-inf")] * 8), (-7, [0.0] * 9)]
    for k, rounds in ((7, 3), (1, 1), (5, 0)):
        got = centroids.cluster(spark.createDataFrame(rows + bad, VECTORS).repartition(5), k=k, rounds=rounds, dim=8).collect()
        check_centroids(got, rows, k, rounds, 8)


def test_ties_go_to_the_smaller_number(spark):
    x, c = np.array([[0, 0], [2, 0], [1, 1]]), np.array([[1, 0], [1, 0], [3, 0]])
    assert centroids.nearest(x, c)[0].tolist() == [0, 0, 0] and centroids.nearest(x, c)[1].tolist() == [1, 1, 1]
    far = np.array([[1 << 24, -(1 << 24)]])
    assert centroids.nearest(far, -far)[1].tolist() == [2 * (1 << 25) ** 2]
    # an empty cluster keeps its centroid: equal first centroids leave all to the first
    rows = [(i, [1.0, 2.0]) for i in range(6)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=3, dim=2).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and len(got) == 6


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = some_vectors(5, 4, 2)
    check_centroids(centroids.cluster(spark.createDataFrame(rows, VECTORS), k=9, dim=4).collect(), rows, 9, 5, 4)
    none = centroids.cluster(spark.createDataFrame([(1, None)], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], VECTORS)).collect() == []


def test_clashing_names_change_nothing(spark):
    """Other columns, with names that the operators use themselves, leave every value as it was."""
    rows = some_vectors(60, 4, 3)
    clean = spark.createDataFrame([(str(i), v) for i, v in rows], "vec_id string, embedding array<float>")
    messy = spark.createDataFrame([(str(i), v, "x", 7, 8, "y", 9) for i, v in rows], MESSY)
    for run in (lambda d: centroids.cluster(d, k=5, dim=4), whitening.whiten):
        key = lambda r: tuple(map(str, r[:2]))
        a, b = sorted(run(clean).collect(), key=key), sorted(run(messy).collect(), key=key)
        assert a == b and len(a) >= 60


def brute_whitening(rows, dim, components=4):
    kept = [(i, integers(v)) for i, v in rows if usable(v) and len(v) == dim]
    fit = np.array(sorted({tuple(q) for _, q in kept}), np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    z = fit - fit.mean(axis=0)
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, sums, np.array(sums) / n, values, vectors, np.trace(cov), kept


def check_whitening(got, rows, dim):
    n, sums, mean, values, vectors, trace, kept = brute_whitening(rows, dim)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, q in kept:
        mine = sorted(by_id[i], key=lambda r: r.component)[:4] if len(by_id[i]) == 4 else sorted(by_id[i], key=lambda r: r.component)[:: len(by_id[i]) // 4]
        white = (np.array(q) - mean) @ vectors / np.sqrt(values)
        if signs is None and min(abs(white)) > 0.05:
            signs = np.sign(white) * np.sign([r.whitened for r in mine])
        assert [r.component for r in mine] == [1, 2, 3, 4] and {r.n for r in mine} == {n}
        assert {r.deviation for r in mine} == {sum((n * x - s) ** 2 for x, s in zip(q, sums, strict=True))}
        assert np.allclose(np.abs([r.whitened for r in mine]), np.abs(white), atol=1e-8)
        assert np.allclose([r.explained for r in mine], values / trace, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in mine)
        assert abs(mine[0].distance - np.linalg.norm(np.array(q) - mean)) < 1e-8
    for i, q in kept:  # one sign a component for all rows
        mine = sorted(by_id[i], key=lambda r: r.component)[:: max(1, len(by_id[i]) // 4)]
        assert np.allclose(np.array([r.whitened for r in mine]) * signs, (np.array(q) - mean) @ vectors / np.sqrt(values), atol=1e-8)


def test_whitening(spark):
    """Copies count once in the fit; rows of another length and unusable ones don't count."""
    rng = np.random.default_rng(5)
    scale = np.array([5.0, 3.0, 2.0, 1.0, 0.5, 0.1])
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * scale + 1]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[8]]
    other = [(-1, [1.0, 2.0]), (-2, []), (-3, None), (-4, [float("inf")] * 6), (-5, [None] * 6), (-6, [1.0] * 9)]
    got = whitening.whiten(spark.createDataFrame(rows + other, VECTORS).repartition(4)).collect()
    odd = [r for r in got if r.vec_id < 0]
    assert sorted((r.vec_id, r.component) for r in odd) == [(-6, 1), (-6, 2), (-6, 3), (-6, 4), (-1, 1), (-1, 2)]
    assert all(r.deviation is None and r.whitened is None and r.n == 300 for r in odd)
    assert len(got) == 4 * len(rows) + 6
    check_whitening([r for r in got if r.vec_id >= 0], rows, 6)


def test_whitening_without_variance(spark):
    rows = [(i, [1.0, 2.0, -3.0]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    line = [(i, [float(i), 0.0]) for i in range(4)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and {round(r.explained, 12) for r in got} == {0.0, 1.0}
    assert all(r.identity_error < 1e-12 for r in got)


def test_deviations_beyond_long_integers():
    x, n = np.array([[1 << 24, -5], [3, 3]]), 10**6
    sums = np.array([7, -7])
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums).to_pylist() == [None, exact[1]]
    assert exact[0] >= 1 << 63


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op13_whitening(spark, SF).collect(), rows, 64)
    check_centroids(queries.op12_centroids(spark, SF).collect(), rows, 40, 5, 64)


def brute_bundle(text):
    """The sum of bound vectors, letter by letter."""
    import regex

    words = regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip()
    if not regex.search(r"\p{L}", text or ""):
        return np.zeros(language_id.DIMS)
    points = [ord(c) for c in f" {words} "]
    vec = {p: language_id.letter_vectors(np.array([p]))[0].astype(int) for p in set(points)}
    total = np.zeros(language_id.DIMS)
    for a, b, c in zip(points, points[1:], points[2:], strict=False):
        total += np.roll(vec[a], 2) * np.roll(vec[b], 1) * vec[c]
    return total


def test_bundles(monkeypatch):
    texts = ["Der Hund, die Katze!", None, "", "12 34 _", "a", "été où; ÉTÉ", "漢字かな", "x" * 700 + " yz" * 200, "ab́c ́"]
    want = np.array([brute_bundle(t) for t in texts])
    assert want[3].any() == 0 and want[4].any()
    for sparse in (0, 10**9):  # both ways of adding up
        monkeypatch.setattr(language_id, "SPARSE", sparse)
        for block, some in ((1 << 18, 256), (16, 2)):  # long texts in pieces
            monkeypatch.setattr(language_id, "BLOCK", block)
            monkeypatch.setattr(language_id, "TEXTS", some)
            monkeypatch.setattr(language_id, "GRAMS", 7)
            assert (language_id.bundle(texts, np.arange(len(texts)), len(texts)) == want).all()
            assert (language_id.bundle(texts, np.array([2, 0, 1, 0, 1, 0, 2, 1, 0]), 3) == [want[[1, 3, 5, 8]].sum(0), want[[2, 4, 7]].sum(0), want[[0, 6]].sum(0)]).all()


def brute_identify(rows):
    """rows: (doc_id, text, lang)."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    model = {}
    for i, text, lang in rows:
        if not held(i) and lang is not None and (v := brute_bundle(text)).any():
            model[lang] = model.get(lang, 0) + v
    out = []
    for i, text, _ in rows:
        v = brute_bundle(text)
        if not model or not v.any():
            out.append((i, held(i), "und", 0.0))
            continue
        best = max(sorted(model), key=lambda x: round(v @ model[x] / np.linalg.norm(model[x]), 9))
        out.append((i, held(i), best, max(0.0, v @ model[best] / np.linalg.norm(v) / np.linalg.norm(model[best]))))
    return out


def test_languages_by_brute_force(spark):
    words = {"de": "der die und ist nicht schön", "en": "the of and is not fine", "fr": "le la et est pas été"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[x].split(), 12)), x) for i, x in enumerate(np.repeat(list(words), 25).tolist())]
    rows += [(200, None, "de"), (201, "", "en"), (202, "123 !?", "zz"), (203, "ist", None), (None, "the fine", "fr"), (None, None, None), (3, "der", "de"), (3, "der", "de")]
    rows += [(300, "und nicht " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.identify(docs).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got, want = sorted(map(tuple, got), key=order), sorted(brute_identify(rows), key=order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    clash = docs.selectExpr("doc_id", "text", "lang", "1 AS held_out", "'x' AS part", "2 AS score", "3 AS `a.b`")
    assert sorted(map(tuple, language_id.identify(clash).collect()), key=order) == got
    assert language_id.identify(docs.limit(0)).collect() == []
    unlearned = language_id.identify(spark.createDataFrame([(0, "abc", None), (1, None, "de")], docs.schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlearned] == [("und", 0.0)] * 2
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs, most=2)


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "abc abd", x) for i, x in ((1, "b"), (2, "a"), (3, "b"), (4, "a"))]
    assert [zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows].count(True) >= 3
    got = language_id.identify(spark.createDataFrame([*rows, (9, "abd", None)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    got = queries.op11_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").where("lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
