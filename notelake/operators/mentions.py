"""Which of a key's notes its answers mention: automata over blocks of paths and names, one pass over each answer, no pair join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, prepared, stage

#: Notes of a key in one automaton, and characters of answers that meet it in one task, about.
BLOCK, PART = 50_000, 1 << 24


def automaton(patterns: list[str]):
    """An automaton whose values are the places of equal patterns; None without patterns. Empty patterns are left out."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        if p:
            places.setdefault(p, []).append(i)
    if not places:
        return None
    made = ahocorasick.Automaton()
    for p, at in places.items():
        made.add_word(p, at)
    made.make_automaton()
    return made


def found(made, text: str) -> set[int]:
    return {i for _, at in made.iter(text) for i in at} if made is not None else set()


def mentions(answers: DataFrame, notes: DataFrame, key: str, answer_id: str = "answer_id") -> DataFrame:
    """(answer_id, path) of answers(answer_id, key, text) that hold the path, or case aside the base name, of one of the notes(key, path) under the same key.

    A key with many notes is cut into blocks, and one with many or long answers into parts, by hash; every block meets every part of its key. An empty path or name is in every answer; rows with a null key, path, answer_id or text mention nothing; repeated rows are one."""
    prepared(answers.sparkSession)
    name = F.lower(F.replace(F.substring_index("path", "/", -1), F.lit(".md"), F.lit("")))
    known = notes.where(F.col(key).isNotNull() & F.col("path").isNotNull()).select(F.col(key).alias("_k"), "path").distinct().withColumn("name", name)
    said = answers.where(F.col(key).isNotNull() & F.col("text").isNotNull() & F.col(answer_id).isNotNull()).select(F.col(key).alias("_k"), F.col(answer_id).alias("_a"), "text")
    size = known.groupBy("_k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    size = stage(size.join(said.groupBy("_k").agg(F.ceil((F.sum(F.length("text") + 1000)) / PART).cast("int").alias("parts")), "_k"), "sizes")  # keys that have both
    block, part = F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("_a", "text"), F.col("parts")).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.join(size, "_k").select("_k", block.alias("block"), many("parts").alias("part"), "path", "name")
    right = said.join(size, "_k").select("_k", many("blocks").alias("block"), part.alias("part"), "_a", "text", F.lower("text").alias("low"))
    kind = dict(said.dtypes)["_a"]

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        out_a, out_p = [], []
        target = pa.schema([(answer_id, q.schema.field("_a").type if q.num_columns else pa.string()), ("path", pa.string())])
        if t.num_rows and q.num_rows:
            paths, names = t.column("path").to_pylist(), t.column("name").to_pylist()
            always = {i for i, (p, n) in enumerate(zip(paths, names, strict=True)) if not p or not n}
            whole, base = automaton(paths), automaton(names)
            for a, text, low in zip(q.column("_a").to_pylist(), q.column("text").to_pylist(), q.column("low").to_pylist(), strict=True):
                hit = always | found(whole, text) | found(base, low)
                out_a += [a] * len(hit)
                out_p += [paths[i] for i in hit]
        return pa.table([pa.array(out_a, target.field(0).type), pa.array(out_p, pa.string())], schema=target)

    keys = ["_k", "block", "part"]
    out = stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"{answer_id} {kind}, path string").distinct(), "mentions")
    dropped(size)
    return out
