"""Language ID by multilingual mixture inference.

Byte trigrams of labelled documents give smoothed likelihoods per language (counts over all training rows, summed before the shuffle). A document is cut
into spans of four words; expectation-maximisation estimates the proportions of languages from the spans' likelihoods, first over all languages, then over
nested sets of the strongest ones, which grow as long as the penalised likelihood rises. The best set's strongest language names the document; the set with its proportions is given too.
Texts that are null or have no letters are ``und`` with score 0 and an empty set. Ties go to the language that sorts first. Without labelled rows every document is ``und``.

Memory: the likelihoods of a batch's spans are held at once up to MOST_CELLS; those of a longer document are worked out anew from its trigrams wherever EM reads them, so that it
takes two bytes a letter and some 30 bytes a word. What is held changes no result: spans, sums and sets are the same. All languages compete at once, whatever their number; the model has
128 KB a language, on the driver and in each worker (MOST_LABELS languages: 1 GB).

Rows: one per document in any order, null doc_ids and repeated rows included; empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, prepared, released, slices, table, utf8
from .kernels import LOWER, words

BUCKETS = 1 << 15
#: More labels than all the world's languages are an error: that is no column of languages.
MOST_LABELS = 8192
#: Languages whose counts a task holds at once.
HELD_LANGUAGES = 256
SPAN_WORDS, ROUNDS, PENALTY = 4, 8, 4.0
#: Spans times languages whose likelihoods are held, and letters times languages whose likelihoods are looked up at once.
MOST_CELLS, STRETCH_CELLS = 1 << 23, 1 << 21
CLEAN = LOWER.copy()
CLEAN[:65] = 32
CLEAN[91:97] = 32
CLEAN[123:128] = 32
LETTER = regex.compile(r"\p{L}")
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte, letters in lower case and other ASCII as spaces; text edges count as spaces."""
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    out = np.empty(len(data), np.uint16)
    for a in range(0, len(data), STRETCH_CELLS):
        b = min(len(data), a + STRETCH_CELLS)
        clean = CLEAN[data[max(a - 1, 0) : b + 1]].astype(np.uint32)
        clean = np.concatenate([[32] * (a == 0), clean, [32] * (b == len(data))]).astype(np.uint32)
        left, here, right = clean[:-2].copy(), clean[1:-1], clean[2:].copy()
        left[first[(first >= a) & (first < b)] - a] = 32
        right[last[(last >= a) & (last < b)] - a] = 32
        out[a:b] = ((left << 16 | here << 8 | right) * np.uint32(2654435761)) >> np.uint32(17)
    return out


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows with text and lang, a row at least for each of these languages; tasks sum the rows of up to HELD_LANGUAGES languages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                code = part.column("lang").dictionary_encode()
                names = code.dictionary.to_pylist()
                of = np.repeat(code.indices.to_numpy().astype(np.int64), np.diff(offsets))
                grams, use = trigrams(data, offsets), CLEAN[data] != 32
                order = np.argsort(of[use], kind="stable") if len(names) > 1 else slice(None)
                kinds, grams = of[use][order], grams[use][order]
                edge = np.searchsorted(kinds, np.arange(len(names) + 1))
                for k, lang in enumerate(names):
                    n = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    n += np.bincount(grams[edge[k] : edge[k + 1]], minlength=BUCKETS)
                    if len(total) >= HELD_LANGUAGES:
                        yield from told(total)
        yield from told(total)
        released()

    def told(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while total:
            lang, n = total.popitem()
            at = np.flatnonzero(n) if n.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and float32 log likelihoods (bucket, language) with add-1/2 smoothing; each language's column is made in a task of its own, and only these columns reach the driver."""

    def column(t: pa.Table) -> pa.Table:
        n = np.full(BUCKETS, 0.5)
        n[t.column("bucket").to_numpy()] += t.column("n").to_numpy()
        return pa.table({"lang": t.column("lang")[:1], "logp": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    made = language_counts(docs).groupBy("lang").applyInArrow(column, "lang string, logp binary").limit(MOST_LABELS + 1).toArrow()
    if made.num_rows > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: this is no column of languages")
    langs, logp = made.column("lang").to_pylist(), np.empty((BUCKETS, made.num_rows), np.float32)
    order = sorted(range(len(langs)), key=langs.__getitem__)
    for k, i in enumerate(order):
        logp[:, k] = np.frombuffer(made.column("logp")[i].as_buffer(), np.float32)
    return [langs[i] for i in order], logp


class Spans:
    """Likelihoods (span, language) of spans of letters, each relative to its best language. Slices of it are worked out when they are read."""

    def __init__(self, grams: np.ndarray, edge: np.ndarray, logp: np.ndarray, best: np.ndarray | None = None):
        self.grams, self.edge, self.logp = grams, edge, logp
        self.shape = (len(edge) - 1, logp.shape[1])
        self.best = best

    def __len__(self) -> int:
        return self.shape[0]

    def logs(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """First span and log likelihoods of stretches of the spans ``a`` to ``b``: whole spans, STRETCH_CELLS letters times languages at once; a longer span by itself in parts."""
        edge, step = self.edge, max(1, STRETCH_CELLS // max(1, self.shape[1]))
        while a < b:
            to = max(a + 1, min(b, int(np.searchsorted(edge, edge[a] + step, "right")) - 1))
            if edge[to] - edge[a] > step:
                yield a, sum(self.logp[self.grams[x : min(x + step, edge[to])]].sum(0, dtype=np.float64) for x in range(edge[a], edge[to], step))[None]
            else:
                yield a, np.add.reduceat(self.logp[self.grams[edge[a] : edge[to]]], edge[a:to] - edge[a], axis=0, dtype=np.float64)
            a = to

    def __getitem__(self, at: slice) -> np.ndarray:
        a, b, _ = at.indices(len(self))
        if self.best is None:
            self.best = np.concatenate([part.max(1) for _, part in self.logs(0, len(self))])
        out = np.empty((b - a, self.shape[1]), np.float32)
        for x, part in self.logs(a, b):
            out[x - a : x - a + len(part)] = np.exp(np.maximum(part - self.best[x : x + len(part), None], -60))
        return out

    def of(self, languages: np.ndarray) -> Spans | np.ndarray:
        """The same spans of fewer languages, held where that is possible."""
        self[0:0]  # the best of all languages
        some = Spans(self.grams, self.edge, np.ascontiguousarray(self.logp[:, languages]), self.best)
        return some[:] if some.shape[0] * some.shape[1] <= MOST_CELLS else some


def spans_of(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray]:
    """The spans of all texts, the texts that have words, and the first span of each of these."""
    starts, ends, first = words(np.where(CLEAN[data] == 32, np.uint8(32), data), offsets)
    n = np.diff(first)
    have = np.flatnonzero(n)
    heads = np.flatnonzero((np.arange(len(starts)) - np.repeat(first[:-1], n)) % SPAN_WORDS == 0)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    grams = trigrams(data, offsets)[CLEAN[data] != 32]  # those around the words' bytes, back to back
    return Spans(grams, np.append(letters[heads], letters[-1]), logp), have, np.searchsorted(heads, first[have])


def mixture(chance: Spans | np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM of language proportions per document: chance (span, language), first span of each document, allowed (document, language). Proportions and log likelihood."""
    size = np.diff(np.append(first, len(chance)))
    share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    value = np.zeros(len(first))
    for turn in range(rounds + 1):
        total = np.zeros(share.shape)
        for d, a, b in stretches(first, len(chance), chance.shape[1]):
            part = chance[a[0] : b] * share[d][np.repeat(np.arange(len(d)), np.diff(np.append(a, b)))]
            all_of = np.maximum(part.sum(1, keepdims=True), 1e-30)
            if turn < rounds:
                part /= all_of
                total[d] += np.add.reduceat(part, a - a[0], dtype=np.float64)
            else:
                value[d] += np.add.reduceat(np.log(all_of[:, 0], dtype=np.float64), a - a[0])
        if turn < rounds:
            share = (total / size[:, None]).astype(np.float32)
    return share, value


def stretches(first: np.ndarray, spans: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Documents with the starts of their spans within a stretch, and its end: together all spans, about STRETCH_CELLS / k at once."""
    step = max(1, STRETCH_CELLS // max(k, 1))
    for a in range(0, spans, step):
        b = min(spans, a + step)
        d = np.arange(int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left")))
        yield d, np.maximum(first[d], a), b


def sets_of(score: Spans | np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Per document the chosen set's proportions (0 outside of it), and all languages' proportions; ``score``: likelihoods (span, language), held or, of one document, as they are read."""
    k = score.shape[1]
    n = np.diff(np.append(first, len(score)))
    every, _ = mixture(score, first, np.ones((len(first), k), np.float32))
    order = np.argsort(-every, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None], 1)
    best, chosen = np.full(len(first), -np.inf), np.zeros((len(first), k), np.float32)
    open_, m = np.arange(len(first)), 0
    while len(open_) and m < k:  # only documents whose last set was better grow theirs
        m += 1
        inside = order[open_, :m] if len(open_) == 1 else None
        if isinstance(score, Spans):
            held = score.of(np.sort(inside[0]))
        else:
            spans = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in open_]) if len(open_) < len(first) else slice(None)
            held = score[spans] if inside is None else score[spans][:, np.sort(inside[0])]
        at = np.cumsum(n[open_]) - n[open_]
        allowed = (rank[open_] < m).astype(np.float32)
        share, value = mixture(held, at, allowed if inside is None else np.ones((1, m), np.float32))
        if inside is not None:
            wide = np.zeros((1, k), np.float32)
            wide[0, np.sort(inside[0])] = share[0]
            share = wide
        value = value - penalty * 0.5 * (m - 1) * np.log(n[open_] + 1)
        better = value > best[open_]
        best[open_[better]], chosen[open_[better]] = value[better], share[better]
        open_ = open_[better]
    return chosen, every


def infer(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: index of its language (-1: none), that language's proportion, the chosen set's proportions, and the share of the text that the set covers when all languages compete."""
    docs, k = len(offsets) - 1, logp.shape[1]
    lang, score, share, cover = np.full(docs, -1), np.zeros(docs), np.zeros((docs, k), np.float32), np.zeros(docs)
    if not k or not len(data):
        return lang, score, share, cover
    spans, have, first = spans_of(data, offsets, logp)
    edge = np.append(first, len(spans))
    cells, a = (edge[1:] + np.arange(1, len(have) + 1)) * k, 0
    while a < len(have):  # documents whose likelihoods can be held together, or one
        b = max(a + 1, int(np.searchsorted(cells, (cells[a - 1] if a else 0) + MOST_CELLS, "right")))
        part = Spans(spans.grams, spans.edge[edge[a] : edge[b] + 1], logp)
        few = part.shape[0] * k <= MOST_CELLS
        at = have[a:b]
        lang[at], score[at], share[at], cover[at] = named(*sets_of(part[:] if few else part, first[a:b] - first[a], penalty))
        a = b
    return lang, score, share, cover


def named(chosen: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pick = chosen.argmax(1)
    at = np.arange(len(pick))
    return pick, np.clip(np.minimum(chosen[at, pick], every[at, pick]), 0, 1), chosen, np.clip(np.where(chosen > 0, every, 0).sum(1), 0, 1)


def letterless(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts without a letter. Only those without an ASCII one are looked at as text."""
    ascii_ = np.append(((data | 32) >= 97) & ((data | 32) <= 122), False).astype(np.int64)
    none = np.add.reduceat(ascii_, np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0) == 0 if len(offsets) > 1 else np.zeros(0, bool)
    for i in np.flatnonzero(none):
        none[i] = not LETTER.search(column[int(i)].as_py() or "")
    return none


#: What a prediction adds to a row.
ADDED = [("lang_pred", "string"), ("score", "double"), ("mixture", "array<struct<lang:string,share:float>>"), ("cover", "double")]


def listed(langs: list[str], share: np.ndarray) -> list[dict]:
    """A set with its proportions, strongest first."""
    return [{"lang": a, "share": b} for a, b in sorted(((langs[j], float(share[j])) for j in np.flatnonzero(share > 0)), key=lambda x: (-x[1], x[0]))]


def judged(batch: pa.RecordBatch, langs: list[str], logp: np.ndarray) -> dict:
    """lang_pred, score, mixture (languages of the set, strongest first) and cover for a batch with ``text``."""
    data, offsets = utf8(batch.column("text"))
    lang, score, share, cover = infer(data, offsets, logp)
    blank = letterless(batch.column("text"), data, offsets)
    lang[blank], score[blank], cover[blank] = -1, 0, 0
    return {"lang_pred": [langs[x] if x >= 0 else "und" for x in lang], "score": score, "mixture": [[] if x < 0 else listed(langs, p) for x, p in zip(lang, share, strict=True)], "cover": cover}


def predict(docs: DataFrame, train: DataFrame, keep: list[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score, mixture and cover (their names behind ``prefix``) of whole texts, learned from ``train(text, lang)``."""
    spark, keep = prepared(docs.sparkSession), list(keep)
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    langs, logp = fit(train)
    model = spark.sparkContext.broadcast(logp)
    schema = [*(f"`{c}` {kind}" for c, kind in rows.select(keep).dtypes), *(f"`{prefix}{c}` {kind}" for c, kind in ADDED)]
    return mapped(rows, lambda batch: {c: batch.column(c) for c in keep} | {prefix + c: x for c, x in judged(batch, langs, model.value).items()}, ", ".join(schema), "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from labelled documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text", "lang")
    found = predict(docs, docs.where(f"not coalesce({HELD}, false)"))
    return found.selectExpr("doc_id", f"coalesce({HELD}, false) held_out", "lang_pred", "score", "mixture")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Pipeline stage: rows whose languages are known and, when all languages compete, hold at least ``least`` of the text stay as they are, with all their columns. Each row
    is judged by itself, so null and repeated doc_ids change nothing. Mixed texts are not unclean: the share is that of the whole set."""
    prefix = "_" * (1 + max(map(len, docs.columns)))  # no column of the documents begins so
    found = predict(docs, docs.where(f"not coalesce({HELD}, false)"), docs.columns, prefix)
    return found.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}cover") >= least)).select(docs.columns)
