"""Model event streams and request rates, in batch and with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import parsed
from ..functions.text import is_blank
from ..session import ship

#: Malformed events that end a stream.
MOST_ERRORS = 5


def decode(line: Column) -> Column:
    """struct<ok, kind, text, input_tokens, output_tokens> of a ``data: `` line; null for other lines and the end marker."""
    data = F.substring(line, 7, 2_147_483_647)
    v = parsed(data)
    get = lambda p, t: F.try_variant_get(v, p, t)
    kind = get("$.type", "string")
    made = F.struct(
        v.isNotNull().alias("ok"),
        kind.alias("kind"),
        F.when((kind == "content_block_delta") & (get("$.delta.type", "string") == "text_delta"), get("$.delta.text", "string")).alias("text"),
        F.when(kind == "message_start", get("$.message.usage.input_tokens", "bigint")).alias("input_tokens"),
        F.when(kind == "message_delta", get("$.usage.output_tokens", "bigint")).alias("output_tokens"),
    )
    return F.when(line.startswith("data: ") & (data != "[DONE]"), made)


def fold(lines: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """Per stream: content in order, last token counts, errors, failed. Batch form."""
    e = lines.select(key, order, decode(F.col("line")).alias("e")).where("e is not null")
    out = e.groupBy(key).agg(
        F.expr(f"listagg(e.text, '') within group (order by {order})").alias("content"),
        F.max_by("e.input_tokens", F.when(F.col("e.input_tokens").isNotNull(), F.col(order))).alias("input_tokens"),
        F.max_by("e.output_tokens", F.when(F.col("e.output_tokens").isNotNull(), F.col(order))).alias("output_tokens"),
        F.count_if(~F.col("e.ok")).alias("errors"),
    )
    return out.select(key, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), "errors", (F.col("errors") >= MOST_ERRORS).alias("failed"))


def lines_of(chunks: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "chunk") -> DataFrame:
    """(key, order, line) of streams that came in chunks(key, order, text) cut anywhere: lines are numbered from 0, what stands behind the last line break is a line too, blank ones are left out."""
    whole = chunks.groupBy(key).agg(F.expr(f"listagg({text}, '') within group (order by {order})").alias("_w"))
    rows = whole.select(key, F.posexplode(F.split("_w", "\n")).alias(order, "line"))
    return rows.where(~is_blank(F.col("line")))


def fold_stream(rows: DataFrame, key: str = "stream_id", order: str = "seq", idle: int | None = None) -> DataFrame:
    """The same of a streaming DataFrame of rows(key, order from 0, line) or of rows(key, order from 0, chunk), chunks being cut anywhere; an updated row per stream and trigger, by ``order`` across triggers.

    State of a stream: its text so far, counters, the tail of an unfinished line, and rows that came before their turn; it ends with the stream's end event, or after ``idle`` milliseconds without news, for queries that run on (with such a timeout Spark never ends an available-now query)."""
    ship(rows.sparkSession)
    whole_lines = "line" in rows.columns
    kind = dict(rows.dtypes)[key]
    plain = rows.select(key, F.col(order).cast("bigint").alias("_o"), F.col("line" if whole_lines else "chunk").alias("_t"))
    fields = "content string, input_tokens long, output_tokens long, errors long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, inp, out, errors, turn, tail, waiting = state.get if state.exists else ("", 0, 0, 0, 0, "", "{}")
        if state.hasTimedOut:
            state.remove()
            text, inp, out, errors, _ = told(tail, text, inp, out, errors)
            yield row(k, text, inp, out, errors, True)
            return
        early = {int(a): b for a, b in json.loads(waiting).items()}
        for f in frames:
            early.update((int(a), b or "") for a, b in zip(f["_o"], f["_t"], strict=True) if a >= turn)
        ended = False
        while turn in early:
            now = early.pop(turn)
            *lines, tail = [now, ""] if whole_lines else (tail + now).split("\n")
            for line in lines:
                text, inp, out, errors, end = told(line, text, inp, out, errors)
                ended |= end
            turn += 1
        if ended and not early:
            state.remove()
        else:
            state.update((text, inp, out, errors, turn, tail, json.dumps(early)))
            if idle:
                state.setTimeoutDuration(idle)
        yield row(k, text, inp, out, errors, ended)

    def told(line: str, text: str, inp: int, out: int, errors: int) -> tuple[str, int, int, int, bool]:
        """Text and counters after one line, and whether it ends the stream."""
        if not line.startswith("data: ") or not line.strip():
            return text, inp, out, errors, False
        if line[6:] == "[DONE]":
            return text, inp, out, errors, True
        try:
            e = json.loads(line[6:])
            kind = e.get("type")
            if kind == "message_start":
                inp = int(e["message"]["usage"]["input_tokens"])
            elif kind == "message_delta":
                out = int(e["usage"]["output_tokens"])
            elif kind == "content_block_delta" and e["delta"].get("type") == "text_delta":
                text += e["delta"]["text"]
            return text, inp, out, errors, kind == "message_stop"
        except (ValueError, KeyError, TypeError, AttributeError):
            return text, inp, out, errors + 1, False

    def row(k: tuple, text: str, inp: int, out: int, errors: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "content": [text], "input_tokens": [inp], "output_tokens": [out], "errors": [errors], "failed": [errors >= MOST_ERRORS], "ended": [ended]})

    return plain.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {fields}, failed boolean, ended boolean", f"{fields}, turn long, tail string, waiting string", "update", "ProcessingTimeTimeout" if idle else "NoTimeout")


def rate_window(requests: DataFrame, key: str, ts: str = "ts", seconds: int = 60, most: int = 10) -> DataFrame:
    """Requests of a key in the window that ends with each (its start left out): count, whether another may follow, seconds until it may."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    rows = requests.withColumn("_t", micros).withColumn("in_window", F.count("*").over(w)).withColumn("_first", F.min("_t").over(w))
    wait = F.when(F.col("in_window") >= most, (F.col("_first") + seconds * 1_000_000 - F.col("_t")) / 1_000_000).otherwise(0.0)
    return rows.withColumns({"allowed": F.col("in_window") < most, "wait_seconds": wait}).drop("_t", "_first")


def rate_stream(requests: DataFrame, key: str, ts: str = "ts", seconds: int = 60, slide: int = 10, late: str = "1 minute") -> DataFrame:
    """Requests per key and sliding window of event time, with a watermark."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count("*").alias("requests"))


def upsert_each_batch(write, key: str, order: str):
    """A ``foreachBatch`` function that hands the latest row of each key of a batch to ``write(df, epoch)``; a replayed batch gives the same rows."""

    def run(df: DataFrame, epoch: int) -> None:
        latest = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_x"))
        write(latest.select(key, "_x.*"), epoch)

    return run
