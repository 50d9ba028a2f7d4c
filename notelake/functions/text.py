"""Strings as the note application treats them: white space, UTF-16 lengths, hashes, token estimates, truncation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space of the language the notes' application is written in.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters in a row.
WHITE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Ranges whose characters count as a token each.
CJK = r"[\u4e00-\u9fff\u3400-\u4dbf\uac00-\ud7af\u3040-\u309f\u30a0-\u30ff]"
#: One range around them, which is much faster to look for.
FAR_EAST = r"[\u3040-\ud7af]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: Fixed value: what marks a shortened text.
TRUNCATED = "\n\n[content truncated]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def spaced(c: Column) -> Column:
    """Runs of white space as one space. Few texts hold white space other than ASCII's and the no-break space; only those need the whole class, which is slow to match."""
    far = F.regexp_replace(c, rf"{WS}+", " ")
    near = F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")
    return F.when(c.contains("\u00a0") | c.rlike(r"[\u1680-\uFEFF]"), far).otherwise(near)


def utf16_length(c: Column) -> Column:
    return (F.length(c) + F.regexp_count(c, F.lit(ASTRAL))).cast("bigint")


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def estimate_tokens(c: Column) -> Column:
    """Two thirds of a token a character, one for CJK ones; null and '' are 0."""

    def counted(t: Column) -> Column:
        cjk = F.when(t.rlike(FAR_EAST), F.regexp_count(t, F.lit(CJK))).otherwise(0).cast("bigint")
        return F.floor((2 * (utf16_length(t) - cjk) + 2) / 3).cast("bigint") + cjk

    return F.coalesce(let(c, counted), F.lit(0).cast("bigint"))


def estimate_model_tokens(c: Column) -> Column:
    """A quarter of a token a character, with a fifth on top."""
    return F.ceil(F.ceil(utf16_length(c) / F.lit(4.0)) * F.lit(1.2).cast("double")).cast("bigint")


def last_index(text: Column, what: str, upto: Column) -> Column:
    """0-based start of the last occurrence that starts at ``upto`` or before; -1 without one."""
    head = F.substring(text, F.lit(1), (upto + len(what)).cast("int"))
    back = F.instr(F.reverse(head), what[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back - len(what) + 1).cast("bigint")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    """Texts over ``limit`` tokens cut at a paragraph, sentence or word break near the end, marked as cut. Positions are code points."""

    def cut(x: Column) -> Column:
        t, target = x["t"], x["target"]
        paragraph, word = last_index(t, "\n\n", target), last_index(t, " ", target)
        # ends in this order; one counts when it starts behind the end of the best so far
        ends = F.array(*[F.struct(last_index(t, e, target).alias("at"), F.lit(len(e)).cast("bigint").alias("n")) for e in (". ", "! ", "? ", "。", "！", "？")])
        sentence = F.aggregate(ends, F.lit(-1).cast("bigint"), lambda best, e: F.when(e["at"] > best, e["at"] + e["n"]).otherwise(best))
        at = let(F.struct(paragraph.alias("p"), sentence.alias("s"), word.alias("w")), lambda b: F.when(b["p"] > target * F.lit(0.7), b["p"]).when(b["s"] > target * F.lit(0.7), b["s"]).when(b["w"] > target * F.lit(0.8), b["w"]).otherwise(target))
        return F.when(x["now"] <= limit, t).otherwise(F.concat(trim(F.substring(t, F.lit(1), at.cast("int"))), F.lit(TRUNCATED)))

    sized = let(text, lambda t: F.struct(t.alias("t"), estimate_tokens(t).alias("now")))
    return let(sized, lambda x: let(F.struct(x["t"].alias("t"), x["now"].alias("now"), F.floor(F.length(x["t"]) * F.try_divide(F.lit(float(limit)), x["now"]) * F.lit(0.95).cast("double")).cast("bigint").alias("target")), cut))


def was_truncated(c: Column) -> Column:
    return c.contains("[content truncated]")


def preview(c: Column, most: int = 500) -> Column:
    cut = trim(F.substring(c, 1, most))
    return F.when(F.length(c) > most, F.concat(cut, F.lit("..."))).otherwise(cut)


#: Start and factor of the hash, how many units of a long text it takes from either end.
DJB2_START, DJB2_FACTOR, HEAD, TAIL = 5381, 33, 1000, 500


def _djb2_of(units: list[np.ndarray]) -> pa.Array:
    """32-bit djb2 of arrays of UTF-16 units as eight hexadecimal digits: the sum of units times powers of the factor, of all texts at once."""
    size = np.array([len(u) for u in units], np.int64)
    most = int(size.max(initial=0))
    power = np.ones(most + 1, np.uint32)
    np.multiply.accumulate(np.full(most, DJB2_FACTOR, np.uint32), out=power[1:])
    flat = np.concatenate([*units, np.zeros(1, np.uint16)]).astype(np.uint32)
    ends = np.cumsum(size)
    flat[:-1] *= power[np.repeat(ends, size) - 1 - np.arange(len(flat) - 1)]
    total = np.add.reduceat(flat, np.minimum(ends - size, len(flat) - 1), dtype=np.uint32) if len(size) else np.zeros(0, np.uint32)
    total = np.where(size == 0, np.uint32(0), total) + np.uint32(DJB2_START) * power[size]
    return pa.array([f"{x:08x}" for x in total.tolist()], pa.string())


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _hashed(rows: pa.Array, units) -> pa.Array:
    """A hash of each row, null for null; in pieces, so that memory does not follow the batch."""
    out = []
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        hashes = _djb2_of([units(x) if x is not None else _units("") for x in part.to_pylist()])
        out.append(pc.if_else(part.is_valid(), hashes, pa.scalar(None, pa.string())))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _djb2(texts: pa.Array) -> pa.Array:
    return _hashed(texts, _units)


def _sampled(row: dict) -> np.ndarray:
    u = _units(row["ends"])
    return np.concatenate([u if row["n"] <= HEAD + TAIL else np.concatenate([u[:HEAD], u[-TAIL:]]), _units(f":{row['n']}")])


@F.arrow_udf(StringType())
def _content_hash(rows: pa.Array) -> pa.Array:
    return _hashed(rows, _sampled)


def djb2(c: Column) -> Column:
    """32-bit djb2 over UTF-16 units as eight hexadecimal digits; an Arrow function, as a fold over units step by step is far slower."""
    return _djb2(c)


def content_hash(c: Column) -> Column:
    """djb2 of the text with white space collapsed; of long ones the first 1000 and last 500 units; and the length."""

    def sample(t: Column) -> Column:  # as many characters as hold the units at either end; only they go to Python
        ends = F.when(F.length(t) > HEAD + TAIL, F.concat(F.substring(t, 1, HEAD), F.right(t, F.lit(TAIL)))).otherwise(t)
        return F.when(t.isNotNull(), F.struct(ends.alias("ends"), utf16_length(t).alias("n")))

    return _content_hash(let(trim(spaced(c)), sample))
