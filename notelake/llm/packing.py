"""Best-fit packing by a linear grouping scheme.

Tokenised documents become pieces of at most ``capacity`` tokens. Sizes are integers, so the whole corpus is a histogram of ``capacity`` counts, and
only that reaches the driver. Large sizes are rounded up within groups of equal cardinality; the fractional packing of these few sizes is optimised by column
generation over configurations and rounded down; actual documents are substituted, largest first; what is left, and then the small ones, goes
best-fit into the gaps. The packing is kept as runs (equal sequences), whose number depends on capacity and groups, never on the corpus: pieces find
their place by their rank within their size.

null text: empty, one piece that holds the end id alone. Repeated rows are packed as separate documents.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepared, released, slices, stage, table

CAPACITY, END_ID, GROUPS, SMALL = 1024, 2, 192, 8
#: Columns are generated until the fractional optimum is proven to be within this share (the price of the best column bounds it).
SLACK = 0.01
KEPT_WORDS, JOINED = 400_000, 256
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: The byte-level pre-tokeniser's pattern with its Unicode classes written out for the characters of ORDINARY.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
ORDINARY = re.compile(r"[\t\n\r\x20-\x7e¡-ſ‐-‧‰-›€]*\Z")


class Ids:
    """Token ids as bytes. Ordinary texts are split into pre-tokens, whose ids come from a bounded table; others, and those that hold an added token's content, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # pre-tokens are kept here
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Finds added tokens, which the tokenizer takes out of a text before it splits the rest.
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: byte-level vocabularies write a byte as a character.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.seen: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[str]) -> None:
        """Ids of new pre-tokens. Those that are a space and letters stay apart when written in a row, so they go to the tokenizer many at a time."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        rows = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        apart = [w for row in rows if self.added.search("".join(row)) for w in row]
        rows = [row for row in rows if not self.added.search("".join(row))]
        for row, got in zip(rows, self.tokenizer.encode_batch_fast(list(map("".join, rows)), add_special_tokens=False) if rows else [], strict=True):
            ids = np.array(got.ids)
            upto, ends = np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) for w in row])
            at = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
            if not np.array_equal(upto[at], ends):
                raise ValueError("the tokenizer splits words unlike its pattern")
            raw, cut = ids.astype("<u4").tobytes(), [0, *(4 * (at + 1)).tolist()]
            self.seen.update(zip(row, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
        other = [w for w in words if not (w[0] == " " and w[1:].isalpha())] + apart
        self.seen.update(zip(other, self._encode(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > KEPT_WORDS:  # words of few tokens are the frequent ones
            seen = self.seen = {w: b for w, b in seen.items() if len(b) <= 8}
            if len(seen) > KEPT_WORDS // 2:
                seen.clear()
        split = [PRETOKEN.findall(x) if ORDINARY.match(x) and not self.added.search(x) else None for x in texts]
        met: set[str] = set()
        met.update(*filter(None, split))
        self._learn(list(met.difference(seen)))  # with the hashes that the set holds
        whole = iter(self._encode([x for x, ws in zip(texts, split, strict=True) if ws is None]))
        return [next(whole) if ws is None else b"".join(map(seen.__getitem__, ws)) for ws in split]


@lru_cache(4)
def ids_of(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents; ``rank`` counts the pieces of one length within the task ``part``. To be staged at once, as ranks belong to one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = ids_of(tokenizer or default_tokenizer()), TaskContext.get().partitionId()
        met, end = np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for sub in slices(batch, "text"):
                rows = []
                for key, raw in zip(sub.column("doc_id").to_pylist(), codec.encode([x or "" for x in sub.column("text").to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((key, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), part, int(met[b - a])))
                        met[b - a] += 1
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        released()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES)


# --- the plan, on the driver, from counts per size ---


def grouped(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Sizes >= least, largest first, in at most ``groups`` groups of equal cardinality (last ones smaller); a group: (size, count) pairs."""
    total = int(counts[least:].sum())
    each, out, room = -(-total // groups) if total else 0, [], 0
    for size in range(len(counts) - 1, least - 1, -1):
        left = int(counts[size])
        while left:
            if room == 0:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append((size, take))
            left, room = left - take, room - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Column generation for the fractional packing of few sizes: (how many of each size, how many sequences)."""
    k = len(sizes)
    basis = np.zeros((k, k))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    inverse, level = np.linalg.inv(basis), np.array(demand, float) / np.diag(basis)
    for step in range(most):
        price = np.maximum(inverse.sum(0), 0)  # every sequence costs 1
        column, value = best_load(sizes, price, capacity)
        if value <= 1 + SLACK:
            break
        turn = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(turn > 1e-9, level / turn, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            level = np.maximum(inverse @ np.array(demand, float), 0)
            continue
        level = level - ratio[out] * turn
        level[out] = ratio[out]
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        level = np.maximum(level, 0)
    return [(basis[:, j].astype(int), float(level[j])) for j in range(k) if level[j] > 0]


def best_load(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The dearest load of one sequence (unbounded knapsack, by number of items)."""
    size, best, picks = np.array(sizes), np.zeros(capacity + 1), []
    reach = np.arange(capacity + 1)[None, :] - size[:, None]
    for _ in range(capacity // int(size.min())):
        worth = np.where(reach >= 0, best[np.maximum(reach, 0)] + price[:, None], -1.0)
        pick = worth.argmax(0)
        new = worth[pick, np.arange(capacity + 1)]
        pick = np.where(new > best + 1e-12, pick, -1)
        if (pick < 0).all():
            break
        picks.append(pick)
        best = np.maximum(best, new)
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return column, float(price @ column)


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, number, first sequence, offset) that place every piece, and the number of sequences.

    Piece ``rank`` of ``size`` goes to sequence first + (rank - first rank), at the offset of its run."""
    counts = np.array(counts, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    taken, opened = np.zeros(capacity + 1, np.int64), 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(size: int, number: int, first: int, offset: int) -> None:
        runs.append((size, int(taken[size]), number, first, offset))
        taken[size] += number

    parts = grouped(counts, max(1, capacity // SMALL + 1), groups)
    queues = [list(p) for p in parts]
    found = configurations([p[0][0] for p in parts], [sum(n for _, n in p) for p in parts], capacity) if parts else []
    for column, level in sorted(found, key=lambda x: (-x[1], x[0].tolist())):
        left, slots = int(level + 1e-6), [g for g, n in enumerate(column) for _ in range(n)]
        while left:  # equal sequences until a group's next actual size begins
            here = [(g, queues[g][0][0]) if queues[g] else (g, 0) for g in slots]
            uses = {g: slots.count(g) for g in slots if queues[g]}
            if not uses:
                break
            number = max(1, min([left, *(queues[g][0][1] // n for g, n in uses.items())]))
            if any(queues[g][0][1] < n for g, n in uses.items()):  # too few of a size for all slots of its group: this one sequence takes what comes next
                here = []
                for g in slots:
                    if queues[g]:
                        size, n = queues[g][0]
                        here.append((g, size))
                        queues[g][:1] = [(size, n - 1)] if n > 1 else []
            else:
                for g, n in uses.items():
                    size, have = queues[g][0]
                    queues[g][:1] = [(size, have - n * number)] if have > n * number else []
            offset = 0
            for _, size in here:
                if size:
                    put(size, number, opened, offset)
                    offset += size
            gaps.setdefault(capacity - offset, []).append((opened, number))
            opened, left = opened + number, left - number
    keys = sorted(gaps)
    for size in range(capacity, 0, -1):  # what is left, largest first, each into the smallest gap that holds it
        left = int(counts[size] - taken[size])
        while left:
            at = bisect.bisect_left(keys, size)
            if at == len(keys):
                per = capacity // size
                number = max(1, left // per)
                gaps.setdefault(capacity, []).append((opened, number))
                opened += number
                if capacity not in keys:
                    bisect.insort(keys, capacity)
                continue
            gap = keys[at]
            first, number = gaps[gap].pop()
            per = gap // size
            use = min(number, left // per)
            if use == 0:
                use, per = 1, left
            for j in range(per):
                put(size, use, first, capacity - gap + j * size)
            left -= use * per
            for g, run in ((gap, (first + use, number - use)), (gap - per * size, (first, use))):
                if run[1]:
                    if g not in gaps:
                        gaps[g] = []
                    if g not in keys:
                        bisect.insort(keys, g)
                    gaps[g].append(run)
            if not gaps[gap]:
                del gaps[gap]
                keys.remove(gap)
    return runs, opened


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all pieces of ``docs(doc_id, text)``."""
    prepared(docs.sparkSession)
    cut = stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        total[row.length] = row.n
    runs = np.array(sorted(plan(total, capacity)[0]) or [(0, 0, 0, 0, 0)], np.int64)
    keys = runs[:, 0] << 48 | runs[:, 1]
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, b.column("length").to_numpy() << 48 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
