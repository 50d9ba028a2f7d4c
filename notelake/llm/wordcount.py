"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links; every link carries how many tokens it pops, so greedy longest-match word pieces are counted in
one pass over the bytes without building a piece. Failure chains are folded into one table of (state, byte) -> (state, popped), and all words of
a batch step through it together, as long as many are left. A word is the space mark followed by a run ``[^\\x20\\x09-\\x0D]+``; vocabulary entries that begin with the
mark start words, the others continue them. A word that greedy matching cannot finish counts as one unknown token, as in word-piece models.

null and empty texts: 0 tokens. Repeated rows are counted each, null doc_ids stay, other columns of the input are left out, an empty table gives an empty result. The automaton's size
depends on the vocabulary only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table, utf8
from .kernels import words
from .piece import MARK, default_model


#: Words that step together at least; longer words than all but so many are walked one by one.
FEW = 24


class Automaton:
    """Trie, failure links and popped-token counts of a vocabulary of byte strings; ``start`` is the prefix of every word."""

    def __init__(self, vocabulary: list[bytes], start: bytes):
        goto: list[dict[int, int]] = [{}, {}]  # 0: continuing pieces; 1: pieces that start a word
        final, depth = [False, False], [0, 0]
        for token in vocabulary:
            at = 1 if token.startswith(start) else 0
            for b in token:
                at = goto[at].setdefault(b, len(goto))
                if at == len(goto):
                    goto.append({})
                    final.append(False)
                    depth.append(0)
            final[at] = True
        at = 1
        for b in start:  # the start exists even when no token has it
            at = goto[at].setdefault(b, len(goto))
            if at == len(goto):
                goto.append({})
                final.append(False)
        self.start, n = at, len(goto)
        dead = self.dead = n
        to, pops = np.full((n + 1, 256), dead, np.int32), np.zeros((n + 1, 256), np.uint16)
        fail, popped = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        level = [(0, -1, 0), (1, -1, 0)]
        while level:  # by depth: a failure link leads to a shorter string, whose row is complete
            below = []
            for node, parent, b in level:
                if final[node]:
                    fail[node], popped[node] = 0, 1
                elif parent >= 0 and fail[parent] >= 0 and to[fail[parent], b] != dead:
                    fail[node], popped[node] = to[fail[parent], b], popped[parent] + pops[fail[parent], b]
                if fail[node] >= 0:
                    to[node] = to[fail[node]]
                    pops[node] = np.where(to[node] == dead, 0, popped[node] + pops[fail[node]])
                for c, child in goto[node].items():
                    to[node, c], pops[node, c] = child, 0
                    below.append((child, node, c))
            level = below
        self.to, self.pops = to.ravel(), pops.ravel()
        #: Tokens that a word's end pops; -1 where the rest of the word has no match.
        self.last = np.full(n + 1, -1, np.int64)
        self.last[0] = 0
        for node in range(n):
            chain, total = node, 0
            while chain > 0 and fail[chain] >= 0:
                total += popped[chain]
                chain = fail[chain]
            if chain == 0:
                self.last[node] = total

    def rest(self, state: int, total: int, word: bytes) -> tuple[int, int]:
        """State and popped tokens behind the rest of a word, byte by byte."""
        to, pops = memoryview(self.to), memoryview(self.pops)
        for b in word:
            key = state << 8 | b
            total += pops[key]
            state = to[key]
        return state, total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and whether it is unknown."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, size = starts[order], size[order]
        state, total = np.full(len(order), self.start, np.int64), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else []
        for step, m in enumerate(alive):
            if m < FEW:
                for k in range(m):
                    state[k], total[k] = self.rest(int(state[k]), int(total[k]), data[at[k] + step : at[k] + size[k]].tobytes())
                break
            key = state[:m] * 256 + data[at[:m] + step]
            total[:m] += self.pops[key]
            state[:m] = self.to[key]
        tail = self.last[state]
        out, unknown = np.empty(len(order), np.int64), np.empty(len(order), bool)
        out[order] = np.where(tail < 0, 1, total + tail)
        unknown[order] = tail < 0
        return out, unknown


@lru_cache(4)
def automaton(model_file: str) -> Automaton:
    import sentencepiece as sp

    p = sp.SentencePieceProcessor(model_file=model_file)
    pieces = [p.id_to_piece(i).encode() for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return Automaton(pieces, MARK.encode())


def token_counts(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of whole texts by greedy longest match over the vocabulary of ``model_file``."""

    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column(1))
        starts, ends, first = words(data, offsets)
        n, unknown = automaton(model_file or default_model()).counts(data, starts, ends)
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        return {"doc_id": batch.column(0), "n_words": np.diff(first), "n_tokens": upto(n), "n_unknown": upto(unknown)}

    return mapped(docs.selectExpr(f"cast({id_col} as bigint) id", f"{text_col} text"), kernel, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"))
