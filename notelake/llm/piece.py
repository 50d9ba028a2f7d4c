"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map while every normalised byte keeps the source
byte it came from; pieces of the normalised text are then projected to byte spans of the original. Merges cannot cross from a word into the
next run of spaces when no piece of the vocabulary holds a space mark behind another character (checked at load), so runs "spaces + word" are
segmented on their own and a bounded table of runs already seen answers most of them.

null text: empty; empty text: the begin and end ids only. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table

MARK = "▁"
#: Runs kept by a worker before its table is emptied, and characters of one at most.
KEPT_RUNS, KEPT_LENGTH = 200_000, 64


class CharMap:
    """A compiled character map: 4 bytes of trie size, a double-array trie over source bytes, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            units, text = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
            todo = [(0, b"")]
            while todo:
                node, prefix = todo.pop()
                base = node ^ self._offset(units[node])
                if units[node] >> 8 & 1:
                    start = units[base] & 0x7FFFFFFF
                    self.rules[prefix] = text[start : text.index(b"\0", start)]
                for label in range(1, 256):
                    child = base ^ label
                    if child < len(units) and units[child] & 0x800000FF == label:
                        todo.append((child, prefix + bytes([label])))
        self.longest = max(map(len, self.rules), default=0)
        self.firsts = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in sorted({k[0] for k in self.rules if k})) + b"]") if self.rules else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and for the end) the source byte where its replacement starts."""
        if self.firsts is None or not self.firsts.search(raw):
            return raw, np.arange(len(raw) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            for width in range(min(self.longest, len(raw) - at), 0, -1):
                if (new := self.rules.get(raw[at : at + width])) is not None:
                    out += new
                    source += [at] * len(new)
                    break
            else:
                width = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out += raw[at : at + width]
                source += range(at, min(at + width, len(raw)))
            at += width
        return bytes(out), np.array([*source, len(raw)])


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep and escape white space, as a prefix, are supported")
        self.charmap, self.prefix = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("a piece spans words: runs cannot be segmented on their own")
        spec.precompiled_charsmap, spec.add_dummy_prefix = b"", False
        self.segmenter = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kind = pb.ModelProto.SentencePiece
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else " ⁇ ".encode() if p.type == kind.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.is_byte = [p.type == kind.BYTE for p in proto.pieces]
        self.width = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.begin, self.end = self.segmenter.bos_id(), self.segmenter.eos_id()
        self.seen: dict[str, bytes] = {}
        self.run = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with escaped spaces, and the source byte of each of its bytes and of its end."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        plain, source = self.charmap.apply(raw)
        wide = np.where(np.frombuffer(plain, np.uint8) == 32, 3, 1)
        source = np.concatenate([np.zeros(3 * self.prefix, np.int64), np.repeat(source[:-1], wide), [len(raw)]])
        return MARK * self.prefix + plain.decode().replace(" ", MARK), source

    def pieces(self, normal: list[str]) -> list[np.ndarray]:
        """Piece ids of normalised texts."""
        runs = [self.run.findall(x) for x in normal]
        if len(self.seen) > KEPT_RUNS:
            self.seen.clear()
        here: dict[str, bytes] = {}  # the runs of these texts; short ones are kept for others
        new = list({r for rs in runs for r in rs if r not in self.seen})
        for r, ids in zip(new, self.segmenter.encode(new, num_threads=1) if new else [], strict=True):
            (self.seen if len(r) <= KEPT_LENGTH else here)[r] = np.array(ids, "<u4").tobytes()
        return [np.frombuffer(b"".join([self.seen.get(r) or here[r] for r in rs]), "<u4") for rs in runs]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids with begin and end, and the start and end bytes in the original of every id (begin: 0, 0; end: length, length)."""
        normal = [self.normalise(x) for x in texts]
        out = []
        for ids, (_, source) in zip(self.pieces([x for x, _ in normal]), normal, strict=True):
            edge = np.concatenate([[0], np.cumsum(self.width[ids])])
            if edge[-1] + 1 != len(source):
                raise ValueError("pieces do not cover the normalised text")
            at = source[edge]
            out.append((np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"), np.concatenate([[0], at[:-1], at[-1:]]), np.concatenate([[0], at[1:], at[-1:]])))
        return out

    def decode(self, ids) -> str:
        """The text of ids, as the library's decode gives it: control ids vanish, the first word's space mark too, broken byte runs become U+FFFD byte by byte."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mend(ids)
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if self.prefix and first is not None and not self.is_byte[first] and text.startswith(" ") and self.surface[first] != " ⁇ ".encode() else text

    def _mend(self, ids: list[int]) -> str:
        out, at = [], 0
        while at < len(ids):
            to = at
            while to < len(ids) and self.is_byte[ids[to]]:
                to += 1
            raw, k = b"".join(self.surface[i] for i in ids[at:to]), 0
            while k < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(raw[k : k + width].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    width = 1
                k += width
            if to < len(ids):
                out.append(self.surface[ids[to]].decode())
            at = to + 1
        return "".join(out)


@lru_cache(4)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>, ends array<int>): ids with begin and end, and their byte spans in the original text.

    The model file is read on the executors by its own path (a parameter; the default comes with the tokenizers package)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        got = codec(model_file or default_model()).encode([x or "" for x in batch.column(1).to_pylist()])
        return {"id": batch.column(0), **{name: _lists([g[k] for g in got]) for k, name in enumerate(("ids", "starts", "ends"))}}

    return mapped(docs.selectExpr(f"cast({id_col} as bigint) id", f"{text_col} text"), kernel, "id bigint, ids array<int>, starts array<int>, ends array<int>", "text")


def decode_pieces(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(id, ids, starts, ends) with the column ``decoded``; null ids decode to null."""

    def kernel(batch: pa.RecordBatch) -> dict:
        c = codec(model_file or default_model())
        return {**{n: batch.column(n) for n in ("id", "ids", "starts", "ends")}, "decoded": [None if not x.is_valid else c.decode(x.values.to_numpy()) for x in batch.column("ids")]}

    return mapped(encoded, kernel, "id bigint, ids array<int>, starts array<int>, ends array<int>, decoded string")


def piece_digest(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """Digests of encoded documents: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text that ``decode`` gives) and spans_sha256 (starts, then ends)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        c, out = codec(model_file or default_model()), {n: [] for n in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")}
        for ids, starts, ends in zip(*(batch.column(n) for n in ("ids", "starts", "ends")), strict=True):
            ids, spans = ids.values.to_numpy(), [x.values.to_numpy().astype("<u4").tobytes() for x in (starts, ends)]
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            out["spans_sha256"].append(hashlib.sha256(b"".join(spans)).hexdigest())
        return out | {"doc_id": batch.column("id")}

    return mapped(encoded, kernel, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", "ids")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: encoded with spans, then decoded from its ids."""
    return piece_digest(encode_pieces(table(spark, sf_dir, "documents")))
