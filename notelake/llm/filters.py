"""A filter of bounded size in front of a second reading of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: 64-bit words of the filter: at most 16 MB are broadcast, whatever the number of documents; a full filter only costs work.
MOST_WORDS = 1 << 21


def passed(docs: DataFrame, named: DataFrame, kernel=None, schema: str = "doc_id bigint, text string") -> DataFrame:
    """``kernel`` (from a batch of doc_id and text to columns of ``schema``; none: the rows themselves) over rows of ``docs(doc_id, text)`` whose id is among those of ``named``, and a few others: to be joined with ``named`` after. Texts of the others are neither decoded in Python nor shuffled."""
    spark = docs.sparkSession
    size = 1 << min(MOST_WORDS.bit_length() - 1, max(10, int(named.count() // 4).bit_length()))
    place = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(size * 64)) for k in (1, 2)]
    bits = named.select(F.explode(F.array(*place)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    got = bits.toArrow()
    mask = np.zeros(size, np.int64)
    mask[got.column("w").to_numpy()] = got.column("b").to_numpy()
    sent = spark.sparkContext.broadcast(mask)

    def kept(batch: pa.RecordBatch) -> dict | None:
        p = [np.asarray(batch.column(x)) for x in ("p1", "p2")]
        hit = np.logical_and(*((sent.value[x >> 6] >> (x & 63)) & 1 == 1 for x in p))
        if not hit.any():
            return None
        rows = batch.filter(pa.array(hit)).select(["doc_id", "text"])
        return kernel(rows) if kernel else {"doc_id": rows.column("doc_id"), "text": rows.column("text")}

    return mapped(docs.where("doc_id is not null").select("doc_id", "text", place[0].alias("p1"), place[1].alias("p2")), kept, schema, "text")
