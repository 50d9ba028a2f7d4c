"""Documents with frontmatter: goals, conversations, quiz sessions as tables and back.

Parsing is per document and never fails a query: documents that do not parse are null and can be listed as rejects.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import is_blank, let, trim

#: The document format (front matter, keys, numbers).
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
NAME = re.compile(r"[a-zA-Z0-9_-]+")
NUMBER = re.compile(r"-?\d+(\.\d+)?")
WORDS = {"true": True, "false": False, "null": None, "": None}
MARKED = re.compile(r"[:#\[\]{}|>\n]")


def split_document(c: Column) -> Column:
    """struct<frontmatter, body>; null where there is no frontmatter block."""
    head = F.regexp_extract(c, FRONT, 0)
    return let(head, lambda h: F.when(h != "", F.struct(F.regexp_extract(h, FRONT, 1).alias("frontmatter"), F.substring(c, F.length(h) + 1, F.length(c)).alias("body"))))


def remembered(f):
    """``f`` of a string, worked out once for those of under 64 characters that come again: keys and values do from document to document."""
    kept = lru_cache(1 << 14)(f)

    @wraps(f)
    def call(text: str):
        return kept(text) if len(text) < 64 else f(text)

    return call


@remembered
def scalar(text: str):
    """A YAML scalar: boolean, null, number, quoted or plain string."""
    text = text.strip()
    if text in WORDS:
        return WORDS[text]
    first = text[0]
    if (first == "-" or first.isdigit()) and NUMBER.fullmatch(text):
        return float(text) if "." in text else int(text)
    if first in "\"'" and len(text) > 1 and text[-1] == first:
        inner = text[1:-1]
        return re.sub(r'\\(n|"|\\)', lambda m: "\n" if m[1] == "n" else m[1], inner) if "\\" in inner else inner
    return text


@remembered
def pair_of(line: str) -> tuple[bool, str, str] | None:
    """Whether a ``key: value`` line is indented, its key and what stands behind the colon; None for another line."""
    bare = line.lstrip(" ")
    key, colon, rest = bare.partition(":")
    if colon and ((key.isascii() and key.isidentifier()) or NAME.fullmatch(key)):
        return len(bare) < len(line), key, rest.lstrip()
    return None


def parse_yaml(block: str) -> dict:
    """Scalars, lists, lists of flat objects and flat objects; a key with nothing below it is null. Escapes are undone in one pass, so what ``write_yaml`` makes reads back."""
    out: dict = {}
    held: str | None = None
    for line in block.split("\n"):
        bare = line.lstrip()
        if bare.startswith("- "):
            if held is not None:
                out[held] = out[held] if isinstance(out[held], list) else []
                inner = pair_of(bare[2:])
                out[held].append({inner[1]: scalar(inner[2])} if inner and not inner[0] else scalar(bare[2:]))
        elif bare and (pair := pair_of(line)):
            if not pair[0]:
                held = pair[1] if pair[2] == "" else None
                out[pair[1]] = None if held else scalar(pair[2])
            elif held is not None:
                if out[held] is None:
                    out[held] = {}
                into = out[held][-1] if isinstance(out[held], list) and out[held] else out[held]
                if isinstance(into, dict):
                    into[pair[1]] = scalar(pair[2])
    return out


@remembered
def write_string(value: str) -> str:
    if MARKED.search(value) or scalar(value) != value:
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return value


def write_scalar(value) -> str:
    if isinstance(value, str):
        return write_string(value)
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def write_yaml(fields: dict) -> str:
    """The inverse of ``parse_yaml``; strings that would read back as something else are quoted, which the application's own writer leaves out."""
    lines = []
    for key, value in fields.items():
        if isinstance(value, list):
            lines.append(f"{key}:")
            for x in value:
                pairs = [f"{k}: {write_scalar(v)}" for k, v in x.items()] if isinstance(x, dict) else [write_scalar(x)]
                lines += [("    " if i else "  - ") + p for i, p in enumerate(pairs)]
        elif isinstance(value, dict):
            lines += [f"{key}:", *(f"  {k}: {write_scalar(v)}" for k, v in value.items())]
        else:
            lines.append(f"{key}: {write_scalar(value)}".rstrip())
    return "\n".join(lines)


_json = json.JSONEncoder(ensure_ascii=False).encode


@F.arrow_udf(StringType())
def yaml_to_json(blocks: pa.Array) -> pa.Array:
    return pa.array([None if b is None else _json(parse_yaml(b)) for b in blocks.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def json_to_yaml(fields: pa.Array) -> pa.Array:
    return pa.array([None if f is None else write_yaml(json.loads(f)) for f in fields.to_pylist()], pa.string())


#: Declared not deterministic, so that a filter on what was parsed stays behind it and no document is parsed or written a second time.
yaml_to_json, json_to_yaml = yaml_to_json.asNondeterministic(), json_to_yaml.asNondeterministic()


GOAL = "id string, name string, description string, deadline string, status string, createdAt string, updatedAt string, notesPaths array<string>, milestones array<struct<id:string,content:string,completed:boolean,order:int>>"
CONVERSATION = "id string, goalId string, topic string, createdAt string"
SESSION = "id string, goalId string, createdAt string, completedAt string, score double"


def load(documents: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Documents with ``fields`` by schema and ``body``; both null where the document is unusable."""
    parts = split_document(F.col(content))
    return documents.withColumn("_p", parts).withColumn("fields", F.from_json(yaml_to_json("_p.frontmatter"), schema)).withColumn("body", F.col("_p.body")).drop("_p")


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where("fields.id is not null")


def rejects(loaded: DataFrame) -> DataFrame:
    return loaded.where("fields.id is null")


def save(fields: Column, body: Column) -> Column:
    """A document of a struct and a body."""
    return F.concat(F.lit("---\n"), json_to_yaml(F.to_json(fields)), F.lit("\n---\n"), body)


#: How a message begins, and the parts of a question in a session's body.
HEADER = r"\A## (User|Assistant) - ([^\n\r]+)\z"


def messages(body: Column) -> Column:
    """array<struct<role, timestamp, content, sources>> of a conversation's body; blocks without header or content dropped."""
    blocks = F.transform(F.split(body, r"\n---\n"), trim)
    lines = lambda b: F.split(b, "\n")
    rest = lambda b: F.slice(lines(b), 2, F.size(lines(b)))
    sources = lambda b: F.filter(rest(b), lambda x: x.startswith("Sources: "))
    listed = lambda b: F.when(F.size(sources(b)) > 0, F.filter(F.split(F.substring(F.element_at(sources(b), -1), 10, 1_000_000), ", "), lambda s: trim(s) != ""))
    made = F.transform(
        blocks,
        lambda b: F.struct(
            F.lower(F.regexp_extract(F.get(lines(b), F.lit(0)), HEADER, 1)).alias("role"),
            F.regexp_extract(F.get(lines(b), F.lit(0)), HEADER, 2).alias("timestamp"),
            trim(F.array_join(F.filter(rest(b), lambda x: ~x.startswith("Sources: ")), "\n")).alias("content"),
            listed(b).alias("sources"),
        ),
    )
    return F.filter(made, lambda m: (m["role"] != "") & (m["content"] != ""))


def write_messages(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, body) of messages(key, seq, role, timestamp, content, sources)."""
    block = F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(" - "), F.col("timestamp"), F.lit("\n\n"), F.col("content"), F.when(F.size("sources") > 0, F.concat(F.lit("\n\nSources: "), F.array_join("sources", ", "))).otherwise(""))
    joined = rows.withColumn("_b", block).groupBy(key).agg(F.expr("listagg(_b, '\n\n---\n\n') within group (order by seq)").alias("_j"))
    return joined.select(key, F.concat(F.lit("# Conversation\n\n\n---\n\n"), F.col("_j")).alias("body"))


def recover(content: Column, conversation_id: Column) -> Column:
    """struct<id, topic, createdAt, messages> salvaged from a conversation document that does not parse."""
    block = F.regexp_extract(content, r"\A---\n([\s\S]*?)\n---", 1)
    field = lambda name: F.nullif(trim(F.regexp_extract(block, rf"{name}:\s*[\"']?([^\"'\n]+)[\"']?", 1)), F.lit(""))
    at = F.locate("---", content, 4)
    body = F.when(at > 1, trim(F.substring(content, at + 3, F.length(content)))).otherwise(content)
    return F.struct(F.coalesce(field("id"), conversation_id).alias("id"), F.coalesce(field("topic"), F.lit("Recovered Discussion")).alias("topic"), field("createdAt").alias("createdAt"), messages(body).alias("messages"))


def questions(body: Column) -> Column:
    """array<struct<ordinal, type, text, source_note_path, options, correct_answer, user_answer, is_correct, explanation>> of a session's body.

    Ordinals are places among valid questions (stable keys); an open answer ends before its Status line."""
    sections = F.filter(F.split(body, r"\n## Question \d+"), lambda s: ~is_blank(s))
    found = lambda s, p: F.regexp_extract(s, p, 1)
    given = lambda x: F.nullif(x, F.lit(""))
    options = lambda s: F.transform(F.filter(F.split(found(s, r"Options:\n((?:- [^\n]+\n?)+)"), "\n"), lambda x: x.startswith("- ")), lambda x: trim(F.substring(x, 3, 1_000_000)))
    answer = lambda s: trim(F.regexp_replace(found(s, r"(?s)#### User Answer\n(.*?)(?=\n#### Feedback|\z)"), r"\n\s*Status: (Correct|Incorrect)\s*\z", ""))
    # what a section says, read once; then what it means
    read = F.transform(
        sections,
        lambda s: F.struct(
            s.alias("s"),
            found(s, r"Type: (multiple-choice|open-ended)").alias("type"),
            found(s, r"### ([^\n]+)").alias("text"),
            found(s, r"Source: ([^\n]+)").alias("source"),
            found(s, r"Correct: (\d)").alias("correct"),
            (s.contains("#### User Answer\n") & s.contains("#### Feedback\n") & s.rlike("Status: (Correct|Incorrect)")).alias("answered"),
        ),
    )
    made = F.transform(
        read,
        lambda r: F.struct(
            given(r["type"]).alias("type"),
            trim(given(r["text"])).alias("text"),
            trim(given(r["source"])).alias("source_note_path"),
            options(r["s"]).alias("options"),
            given(r["correct"]).cast("int").alias("correct_answer"),
            F.when(r["answered"], answer(r["s"])).alias("user_answer"),
            F.when(r["answered"], r["s"].contains("Status: Correct")).alias("is_correct"),
            F.when(r["answered"], trim(found(r["s"], r"(?s)#### Feedback\n(.*)"))).alias("explanation"),
        ),
    )
    choice = lambda q: (q["type"] == "multiple-choice") & (F.size(q["options"]) == 4) & q["correct_answer"].isNotNull()
    good = F.filter(made, lambda q: F.coalesce(q["text"].isNotNull() & q["source_note_path"].isNotNull() & (choice(q) | (q["type"] == "open-ended")), F.lit(False)))
    return F.transform(good, lambda q, i: F.struct(i.alias("ordinal"), *[q[n].alias(n) for n in ("type", "text", "source_note_path", "options", "correct_answer", "user_answer", "is_correct", "explanation")]))


def write_questions(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, body) of questions(key, ordinal, type, text, source_note_path, options, correct_answer, user_answer, is_correct, explanation)."""
    choice = F.when(F.col("type") == "multiple-choice", F.concat(F.lit("Options:\n"), F.array_join(F.transform("options", lambda o: F.concat(F.lit("- "), o)), "\n"), F.lit("\nCorrect: "), F.col("correct_answer").cast("string"), F.lit("\n\n"))).otherwise("")
    answer = F.when(F.col("user_answer").isNotNull(), F.concat(F.lit("#### User Answer\n"), "user_answer", F.lit("\n\nStatus: "), F.when(F.col("is_correct"), "Correct").otherwise("Incorrect"), F.lit("\n\n#### Feedback\n"), "explanation", F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("## Question "), (F.col("ordinal") + 1).cast("string"), F.lit("\nType: "), "type", F.lit("\nSource: "), "source_note_path", F.lit("\n\n### "), "text", F.lit("\n\n"), choice, answer)
    joined = rows.withColumn("_b", block).groupBy(key).agg(F.expr("listagg(_b, '') within group (order by ordinal)").alias("_j"))
    return joined.select(key, F.concat(F.lit("# Q&A Session\n\n"), F.col("_j")).alias("body"))


def upsert(table: DataFrame, rows: DataFrame, key: str, keep: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """Rows merged into a table by key: given fields win, nulls and ``keep`` columns stay, ``updated_at`` becomes ``now``."""
    new = rows.select(key, F.struct(*[F.col(c) for c in rows.columns]).alias("_n"))
    merged = table.join(new, key, "full_outer")
    held = set(rows.columns)

    def value(c: str) -> Column:
        if c == "updated_at" and now is not None:
            return F.when(F.col("_n").isNotNull(), now).otherwise(F.col(c)).alias(c)
        if c == key or c not in held:
            return F.col(c)
        return (F.coalesce(F.col(c), F.col(f"_n.{c}")) if c in keep else F.coalesce(F.col(f"_n.{c}"), F.col(c))).alias(c)

    return merged.select(*map(value, table.columns))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "goal_id") -> dict[str, DataFrame]:
    """All tables without the rows of deleted goals."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def replace_last(messages_: DataFrame, new: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The last message of each conversation in new(key, content) with its content replaced."""
    last = messages_.groupBy(key).agg(F.max("seq").alias("seq"))
    put = new.join(last, key).select(key, "seq", F.col("content").alias("_c"))
    return messages_.join(put, [key, "seq"], "left").withColumn("content", F.coalesce("_c", "content")).drop("_c").select(messages_.columns)
