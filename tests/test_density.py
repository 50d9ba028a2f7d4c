"""Density clustering and exact neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import density, neighbours
from notelake.operators.components import components


def reach(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    far = np.sort(d + np.diag(np.full(len(x), np.inf)), 1)
    core = far[:, min(k, len(x) - 1) - 1] if len(x) > 1 else np.zeros(len(x))
    return np.maximum(np.maximum(core[:, None], core[None, :]), d)


def parts(m: np.ndarray, of: list[int], below: float) -> list[list[int]]:
    left, out = set(of), []
    while left:
        todo, got = [left.pop()], []
        while todo:
            i = todo.pop()
            got.append(i)
            near = [j for j in left if m[i, j] < below]
            left -= set(near)
            todo += near
        out.append(sorted(got))
    return out


def brute(x: np.ndarray, size: int, k: int, single: bool) -> dict[int, int]:
    """Top-down over all thresholds; several large parts at once are a split, one goes on, none ends."""
    m = reach(x, k)
    np.fill_diagonal(m, np.inf)
    weights = sorted(set(m[np.isfinite(m)].tolist()), reverse=True)
    clusters: list[dict] = []

    def follow(rows: list[int], birth: float, parent: int | None) -> None:
        me = len(clusters)
        clusters.append({"parent": parent, "kids": [], "rows": list(rows), "s": 0.0})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        now = rows
        for w in weights:
            if w >= 1 / birth if birth else False:
                continue
            got = parts(m, now, w)
            if len(got) == 1 and len(got[0]) == len(now):
                continue
            large = [g for g in got if len(g) >= size]
            lam = 1 / w if w else math.inf
            if len(large) == 1:
                clusters[me]["s"] += (len(now) - len(large[0])) * (lam - birth)
                now = large[0]
                continue
            clusters[me]["s"] += len(now) * (lam - birth)
            clusters[me]["split"] = lam
            for g in large:
                follow(g, lam, me)
            return

    if len(x) >= size:
        follow(list(range(len(x))), 0.0, None)
    chosen: set[int] = set()

    def best(c: int) -> float:
        under = sum(best(k) for k in clusters[c]["kids"])
        if (single or clusters[c]["parent"] is not None) and not (clusters[c]["kids"] and under > clusters[c]["s"]):
            drop = list(clusters[c]["kids"])
            while drop:
                d = drop.pop()
                chosen.discard(d)
                drop += clusters[d]["kids"]
            chosen.add(c)
            return clusters[c]["s"]
        return under

    if clusters:
        best(0)
    out = dict.fromkeys(range(len(x)), -1)
    for c in chosen:
        for i in clusters[c]["rows"]:
            out[i] = c
    return out


def groups(labels: dict) -> set:
    out: dict = {}
    for i, c in labels.items():
        if c != -1:
            out.setdefault(c, set()).add(i)
    return {frozenset(v) for v in out.values()}


def data(kind: str) -> np.ndarray:
    r = np.random.default_rng(11)
    blobs = np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 40), ((4, 0), 0.5, 35), ((4, 3), 0.2, 25), ((0.8, 1.2), 0.1, 15))])
    noise = r.uniform(-3, 7, (25, 2))
    if kind == "blobs":
        return np.concatenate([blobs, noise])
    if kind == "grid":  # nothing but ties
        return np.array([(i, j) for i in range(6) for j in range(5)] + [(20 + i, j) for i in range(4) for j in range(4)] + [(11.0, 2.0)], float)
    return np.concatenate([np.repeat(blobs[:3], [9, 2, 4], axis=0), np.repeat([[50.0, 50.0]], 12, axis=0), blobs[40:70], np.round(noise)])


@pytest.mark.parametrize("kind,size,samples,single", [("blobs", 5, 3, False), ("grid", 5, 3, True), ("copies", 5, 3, False)])
def test_equals_brute_force(spark, monkeypatch, kind, size, samples, single):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "VISITORS", 8)
    monkeypatch.setattr(density, "SAMPLE", 4)
    x = data(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    got = {r.id: r.cluster for r in density.density_clusters(df, size, samples, single).collect()}
    want = brute(x, size, samples, single)
    assert groups(got) == groups(want)
    assert set(got) == set(want)
    least = {c: min(i for i, k in got.items() if k == c) for c in set(got.values()) - {-1}}
    assert sorted(least) == list(range(len(least)))
    assert groups(want)


def test_odd_vectors(spark):
    rows = [("a", [0.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", [None, 1.0]), (None, [0.0, 0.0]), ("e", [0.0, 0.0]), ("f", [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("cluster", F.lit(9))
    got = {r.id: r.cluster for r in density.density_clusters(df, 2, 1, True).collect()}
    assert got == {"a": 0, "b": -1, "c": -1, "d": -1, "e": 0, "f": 0}
    assert density.density_clusters(df.where("false")).count() == 0
    assert {r.cluster for r in density.density_clusters(df.where("id = 'a'")).collect()} == {-1}
    with pytest.raises(Exception, match="dimensions"):
        density.density_clusters(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, embedding array<double>")).collect()


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    x = np.round(np.random.default_rng(3).normal(size=(300, 3)), 1)
    x = np.unique(x, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    rows, cells = neighbours.placed(neighbours.unit(df))
    got = {r.id: [(round(n.d, 9), n.id) for n in r.near] for r in neighbours.neighbours(rows, cells, 5).collect()}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert got[i] == sorted((round(float(d[j]), 9), j) for j in range(len(x)) if j != i)[:5] or [round(n[0], 9) for n in got[i]] == sorted(round(float(v), 9) for j, v in enumerate(d) if j != i)[:5]


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")
    assert {(r.id, r.component) for r in components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_vectors_visit_a_block_once(spark):
    """Of unrelated vectors no cell can be left out: each used to be sent to all 256 cells."""
    import pyarrow as pa

    x = np.random.default_rng(5).normal(size=(3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    rows, cells = neighbours.placed(neighbours.unit(df))
    asking = rows.select("id", "v", "cell", F.lit(float("inf")).alias("within"))
    sent = neighbours.visited(rows, asking, cells, lambda t, q: pa.table({"n": [q.num_rows], "rows": [t.num_rows]}), "n bigint, rows bigint").collect()
    assert sum(r.n for r in sent) <= 8 * 3000
    assert sum(r.n * r.rows for r in sent) == 3000 * 3000


@pytest.mark.parametrize("kind", ["plain", "far", "outliers", "huge", "tiny", "ties", "copies"])
def test_nearest_of_equals_brute_force(kind):
    import pyarrow as pa

    r = np.random.default_rng(9)
    x = r.normal(size=(700, 12))
    if kind == "far":
        x += 1e6
    if kind == "outliers":
        x[:4] *= 1e9
    if kind in ("huge", "tiny"):
        x *= 1e40 if kind == "huge" else 1e-40
    if kind == "ties":
        x = r.integers(0, 2, (700, 12)).astype(float)
    if kind == "copies":
        x[:300] = x[0] + 1e-9 * r.normal(size=(300, 12))
    ids = r.permutation(700)
    t = pa.table({"id": pa.chunked_array([pa.array(ids)]), "v": pa.chunked_array([pa.array([v.tobytes() for v in x], pa.binary())])})
    for within in (np.full(700, np.inf), np.where(np.arange(700) % 3, np.inf, np.abs(x).max() * 2)):
        row, at, d = neighbours.nearest_of(t, t.append_column("within", pa.array(within)), 5)
        got = {}
        for i, j, far in zip(row, at, d, strict=True):
            got.setdefault(i, []).append((far, ids[j]))
        for i in range(700):
            far = neighbours.exact(x, x[i][None, :])
            assert got.get(i, []) == sorted((far[j], ids[j]) for j in range(700) if j != i and far[j] <= within[i])[:5]
