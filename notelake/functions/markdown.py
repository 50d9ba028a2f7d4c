"""Markdown: preparation for embedding, metadata, headings, links, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let, trim

#: Patterns of the note format, as the application reads it.
FRONT = r"(?s)\A---\r?\n.*?---\r?\n?"
CODE = r"(?s)```(\w*)\r?\n.*?```"
IMAGE = r"!\[([^\]]*)\]\([^)]+\)"
FRONT_LINES = r"\A---\r?\n([\s\S]*?)\r?\n---"
TAG = r"(?<![`\w])#([a-zA-Z][a-zA-Z0-9_/-]*)"
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
WORDS_FRONT = r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?"
FENCE = r"(?s)```.*?```"
INLINE = r"`[^`]+`"
#: What the second word count takes out of a text, in order, and what it leaves in place.
PLAIN = ((r"\A---[\s\S]*?---\n?", ""), (FENCE, ""), (INLINE, ""), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", ""))
#: The characters that the second word count takes for words.
WORD_CJK = r"[\u4e00-\u9fff\uac00-\ud7af\u3040-\u309f\u30a0-\u30ff]"


def strip_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, FRONT, "")


def _named(c: Column, pattern: str, label: str) -> Column:
    """Matches of a pattern with one group as ``[label: group]``, the group trimmed and the label itself where it is blank: what stands between the matches, and the groups, put together again."""

    def put(x: Column) -> Column:
        groups = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        one = lambda g: F.concat(F.lit(f"[{label}: "), F.coalesce(F.nullif(trim(g), F.lit("")), F.lit(label)), F.lit("]"))
        return F.when(x.rlike(pattern), F.array_join(F.zip_with(F.split(x, pattern), groups, lambda between, g: F.concat(between, F.when(g.isNull(), "").otherwise(one(g)))), "")).otherwise(x)

    return let(c, put)


def summarize_code(c: Column) -> Column:
    return _named(c, CODE, "code")


def summarize_images(c: Column) -> Column:
    return _named(c, IMAGE, "image")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return trim(F.regexp_replace(F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " "), r"(?md)^ +", ""))


def prepare(c: Column, frontmatter: bool = True, code: bool = True, images: bool = True, whitespace: bool = True) -> Column:
    for use, step in ((frontmatter, strip_frontmatter), (code, summarize_code), (images, summarize_images), (whitespace, normalize_whitespace)):
        c = step(c) if use else c
    return c


def frontmatter(c: Column) -> Column:
    """map<string, string> of a leading block's ``key: value`` lines, the last of a key; quotes at the ends and white space dropped. Lists stay as written (``items`` splits them)."""
    block = F.regexp_extract(c, FRONT_LINES, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 1)
    pair = lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("k"), trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    unquoted = lambda v: F.when(v.rlike(r"\A\[.*\]\z"), v).otherwise(F.regexp_replace(v, r"\A[\"']|[\"']\z", ""))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], unquoted(p["v"]))))


def items(v: Column) -> Column:
    """The values of ``[a, b]``, or a scalar alone; blank ones dropped."""
    inner = F.transform(F.split(F.regexp_replace(v, r"\A\[|\]\z", ""), ","), lambda x: F.regexp_replace(trim(x), r"\A[\"']|[\"']\z", ""))
    return F.when(v.rlike(r"\A\[.*\]\z"), F.filter(inner, lambda x: x != "")).when(v != "", F.array(v)).otherwise(F.array().cast("array<string>"))


def tags(c: Column) -> Column:
    """Distinct tags of the frontmatter, then those in the text outside code, all with ``#``."""
    named = F.transform(F.coalesce(items(F.try_element_at(frontmatter(c), F.lit("tags"))), F.array().cast("array<string>")), lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))
    bare = F.regexp_replace(F.regexp_replace(c, FENCE, ""), INLINE, "")
    return F.array_union(named, F.transform(F.regexp_extract_all(bare, F.lit(TAG), 1), lambda t: F.concat(F.lit("#"), t)))


def links(c: Column) -> Column:
    """Distinct targets of wiki links in order, without alias and anchor; pure anchors dropped."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(LINK), 1), trim)
    return F.array_distinct(F.transform(F.filter(raw, lambda x: (x != "") & ~x.startswith("#")), lambda x: F.substring_index(x, "#", 1)))


def headings(c: Column) -> Column:
    """array<struct<heading, level, line>>; lines count from 1 and may lie in code."""
    pattern = rf"\A(#{{1,6}}){WS}+([^\n\r\u2028\u2029]+)\z"
    found = F.transform(F.split(c, "\n"), lambda x, i: F.struct(trim(F.regexp_extract(x, pattern, 2)).alias("heading"), F.length(F.regexp_extract(x, pattern, 1)).alias("level"), (i + 1).alias("line")))
    return F.filter(found, lambda h: h["level"] > 0)


def count_words(c: Column) -> Column:
    """Words between white space, outside frontmatter and fenced code."""
    bare = F.regexp_replace(F.regexp_replace(c, WORDS_FRONT, ""), FENCE, "")
    return F.regexp_count(bare, F.lit(rf"[^{WS[1:]}+")).cast("bigint")


def count_words_and_cjk(c: Column) -> Column:
    """Words with a Latin letter between white space and punctuation, plus CJK characters; outside frontmatter, code, link targets and HTML tags."""
    for pattern, to in PLAIN:
        c = F.regexp_replace(c, pattern, to)
    words = F.filter(F.split(c, rf"[{WS[1:-1]}\p{{P}}]+"), lambda w: w.rlike("[a-zA-Z]"))
    return (F.size(words) + F.regexp_count(c, F.lit(WORD_CJK))).cast("bigint")


def metadata(content: Column) -> list[Column]:
    """The derived columns of a note."""
    return [tags(content).alias("tags"), links(content).alias("links"), headings(content).alias("headings"), frontmatter(content).alias("frontmatter"), count_words(content).alias("word_count")]
