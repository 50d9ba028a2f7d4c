"""Benchmark decontamination, collocations and hard negatives against brute force; no link of the n-gram join is lost."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import negatives, ngram_join, phrases, winnow
from notelake.llm.registry import QUERIES

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- benchmark decontamination ---


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(docs, items):
    found = []
    for doc_id, text in docs:
        ws, hit, named = bench_words(text), set(), set()
        for item_id, item in items:
            it = bench_words(item)
            n = min(10, len(it))
            wins = {tuple(it[i : i + n]) for i in range(len(it) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    if item_id is not None:
                        named.add(str(item_id))
        found.append((doc_id, len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def bench_case(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "Åb", "É", "你好", "İx", "a1"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([10, 12, 25]))) for i in range(12)] + [(100, text(9)), (101, "W1 w2!"), (102, "nowhere"), (103, None), (104, " .,; "), (None, text(15)), (9, text(11)), (9, text(3))]
    items += [(50, items[0][1]), (50, items[0][1]), (51, items[1][1] + " tail w1")]
    docs = [(i, text(r.choice([0, 5, 9, 30, 200]))) for i in range(40)]
    for i in range(25):  # passages of items, cut and changed
        it = r.choice([x for _, x in items if x]).split()
        a, b = sorted(r.sample(range(len(it) + 1), 2)) if len(it) > 1 else (0, 1)
        docs.append((200 + i, f"{text(7)}\t{'; '.join(it[a:b]).upper() if i % 2 else ' '.join(it)} {text(6)}"))
    docs += [(300, None), (301, ""), (302, "\x00\x7f"), (303, "w1, w2"), (None, items[2][1]), (304, (items[3][1] + " ") * 3), (305, docs[40][1]), (305, docs[40][1]), (306, items[0][1] + " " + items[1][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, folder, seed):
    docs, items = bench_case(seed)
    none = pa.array([None] * len(docs), pa.int64())
    d = folder(
        documents=pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), **{c: none for c in ("words", "print", "start", "size", "cells", "d1", "spans", "items", "n_words")}}),
        benchmark=pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "window": pa.array([None] * len(items), pa.int64())}),
    )
    got = QUERIES["op11_benchmark_decontamination"](spark, d).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)
    df = spark.read.parquet(f"{d}/documents.parquet")
    kept = winnow.decontaminated(df, spark.read.parquet(f"{d}/benchmark.parquet"))
    clean = [i for i, _, n, *_ in brute_hits(docs, items) if not n or i is None]
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_full_bit_map_only_costs_work(spark, monkeypatch):
    docs, items = bench_case(3)
    monkeypatch.setattr(winnow, "MOST_CELLS", 1)
    monkeypatch.setattr(winnow, "LEAST_CELLS", 1)
    found = winnow.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, sum(s.length for s in r.spans), len(r["items"])) for r in found if r.doc_id is not None) == sorted((i, h, n) for i, _, h, n, *_ in brute_hits(docs, items) if i is not None)


# --- collocations ---


def brute_phrases(rows, least, longest, share, best):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = [c for (g, q), c in cand.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * c >= share * a for c in inside):
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, rows_ in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:best], 1))


def phrase_case(seed):
    r = random.Random(seed)
    words = ["new", "york", "city", "Of", "the", "é", "ÉT", "你", "x" * 300, "a b", "-", "(q)"]
    sep = [" ", "  ", "\t", " \t ", ". ", ", ", "\n", "\r\n", " "]
    text = lambda n: "".join(r.choices(words, [9, 8, 7, 9, 9, 3, 2, 2, 1, 1, 2, 1])[0] + r.choice(sep) for _ in range(n))
    rows = [(text(r.choice([0, 3, 50, 400])), r.choice(["en", "de", None, "und", ""])) for _ in range(40)]
    rows += [("new york city new york city " * 40, "en"), (None, "en"), ("", None), (" .,;\t", "fr"), ("alone", "fr"), ("tie a tie b " * 12, "x")]
    return rows + rows[:3]


@pytest.mark.parametrize("seed,longest,flush", [(1, 3, 1 << 20), (2, 4, 50), (3, 2, 1 << 20)])
def test_collocations(spark, monkeypatch, seed, longest, flush):
    monkeypatch.setattr(phrases, "FLUSH", flush)
    rows = phrase_case(seed)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 phrase", "2 words", "3 n", "4 key")
    got = phrases.collocations(df, 10, longest, 50, 25).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, 10, longest, 50, 25)


def test_counts_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 3 * big)], "lang string, phrase string, words int, n bigint")
    assert [r.score for r in phrases.scored(counts, 10).collect()] == [1_000_000 * big * big // ((big + 1) * 3 * big)]


# --- hard negatives ---


def brute_negatives(rows, is_anchor, positives, least, low):
    good = {(i, k, tuple(np.floor(256 * np.asarray(v, np.float64)).astype(int).tolist())) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, k, q in good:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, g) for j, g, v in good if j != i and len(v) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == k)[:positives]:
            fits = sorted((t, m) for t, m, g in scored if g != k and low * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fits[:least], 1)]
    return sorted(out)


def vector_case(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    rows = []
    for i in range(700):
        v = centres[i % 6] + 0.25 * r.normal(size=8)
        rows.append((i, int(r.integers(4)), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(60)]  # copies
    rows += [(2000, None, rows[0][2]), (2100, 1, None), (None, 1, rows[1][2]), (2200, 1, [None] + rows[0][2][1:]), (2300, 1, [float("nan")] * 8), (2400, 2, [float("inf")] * 8), (2500, 1, [0.0] * 8), (2600, 1, [])]
    rows += [(2700, 2, [0.5, 0.5]), (2701, 2, [0.5, 0.4]), (2702, 3, [0.5, 0.45]), (2800, 1, []), (2801, 0, []), rows[100], rows[100], (100, rows[100][1], rows[101][2])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    for name, value in (("SAMPLE", 200), ("LEAF", 8), ("ARITY", 5), ("BLOCK", 40), ("VISITORS", 3), ("CHUNK", 500)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_case(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").selectExpr("*", "1 leaf", "2 v", "3 score", "4 akey")
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, 5, 4, 80).collect()
    flat = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)
    # ties between rows that share a vec_id and a score are the same rows in the result
    assert flat == brute_negatives(rows, lambda i: i % 100 == 0, 5, 4, 80)


def test_tree_leaves_out_but_keeps_whole(spark):
    r = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([c + 0.05 * r.normal(size=(200, 6)) for c in r.normal(size=(8, 6))]))
    tree = negatives.Tree(x[::4])
    extent = negatives.Extent(tree)
    leaf = tree.place(x, extent.seen(x))
    tree.ranged({n: v for n, v in extent.at.items()})
    q, s = x[:50], (x[:50] @ x.T)
    most = s.max(1)
    visited = np.zeros((50, tree.leaves), bool)
    for at, rows in tree.remaining(q, 0.95 * most, most):
        visited[rows, at] = True
    for i in range(50):
        assert set(leaf[(s[i] >= 0.95 * most[i]) & (s[i] <= most[i])]) <= set(np.flatnonzero(visited[i]))
    assert visited.mean() < 0.5


def test_huge_components():
    a = np.array([[1e200, 1.0], [3.0, 2.0]])
    assert negatives.products(a, a).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 13]]


# --- n-gram join ---


def shingles(ws):
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def test_known_components_hide_no_link(spark):
    """x links with q alone, of whose 600 near copies all have a higher bound than q and none links with x."""
    q = [f"q{i}" for i in range(60)]
    copies = [q[:19] + ["changed"] + q[20:] + [f"end{i}"] for i in range(600)]
    for seed in range(2000):
        x = q[:21] + [f"s{seed}"] + q[22:57] + [f"t{seed}"] + q[58:]
        value = [np.sort(ngram_join.shingle_sets(*flat(" ".join(w)))[0]) for w in (x, q, copies[0])]
        point = [np.frombuffer(ngram_join.group_counts(v), "<u2").astype(int) for v in value]
        to_q, to_p = (int(np.minimum(point[0], p).sum()) for p in point[1:])
        if to_p * (56 + 56) > to_q * (56 + 57) and 7 * to_p >= 3 * (56 + 57):
            break
    assert len(shingles(x) & shingles(q)) == 48 and all(len(shingles(x) & shingles(p)) <= 47 for p in copies)
    common = [x[17:26], x[53:62], copies[0][15:24]]
    other = [[f"o{i}_{k}" for k in range(80)] + common[i % 3] for i in range(900)]
    texts = [q, x, *copies, *other]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")).collect()}
    assert all(found[i] == 0 for i in range(602)) and all(found[i] == i for i in range(602, len(texts)))


def flat(text):
    raw = text.encode()
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def test_an_empty_benchmark_hits_nothing(spark, folder):
    docs = pa.table({"doc_id": [1, 2], "text": ["a b c", None]})
    d = folder(documents=docs, benchmark=pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    got = QUERIES["op11_benchmark_decontamination"](spark, d).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == [(i, n, 0, 0, hashlib.sha256(b"").hexdigest(), False) for i, n in ((1, 3), (2, 0))]
