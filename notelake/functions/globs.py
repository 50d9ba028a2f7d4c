"""Path globs as anchored regular expressions with a literal prefix that scans can be pruned by.

``**`` crosses folders where it is a whole segment (elsewhere it is ``*``), ``*`` and ``?`` do not; ``{a,b}``, ``{1..3}``, ``[..]`` with named classes, a leading ``!`` and the extended forms ``@(a|b)``, ``?(a|b)``, ``*(a|b)``, ``+(a|b)`` and ``!(a|b)`` (what is none of these,
within a folder) work, and dot files match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The named classes of characters.
CLASSES = {"alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": " \\t", "digit": "0-9", "lower": "a-z", "punct": r"\p{Punct}", "space": r"\s", "upper": "A-Z", "word": r"\w", "xdigit": "A-Fa-f0-9"}
NAMED = re.compile(r"\[:(\w+):\]")
RANGE, MOST_IN_RANGE = re.compile(r"\{(-?\d+|[a-zA-Z])\.\.(-?\d+|[a-zA-Z])\}"), 1000


def between(first: str, last: str) -> list[str]:
    """The members of a brace range, numbers or letters, up or down; what is neither is left as it is."""
    if (first.lstrip("-").isdigit()) != (last.lstrip("-").isdigit()):
        return [f"{{{first}..{last}}}"]
    number = first.lstrip("-").isdigit()
    a, b = (int(first), int(last)) if number else (ord(first), ord(last))
    if abs(b - a) >= MOST_IN_RANGE:
        raise ValueError(f"the range {first}..{last} is too long")
    step = 1 if b >= a else -1
    return [str(x) if number else chr(x) for x in range(a, b + step, step)]


def parse_patterns(text: str, comments: bool = True) -> list[str]:
    """One pattern a line, trimmed; blank lines and, if asked, lines with # dropped."""
    lines = [x.strip() for x in text.split("\n")]
    return [x for x in lines if x and not (comments and x.startswith("#"))]


def to_regex(glob: str) -> str:
    """The regular expression (without anchors) of a glob."""
    out, at, depth, open_ = [], 0, 0, []
    while at < len(glob):
        c = glob[at]
        if c in "@?*+!" and glob.startswith("(", at + 1):
            out.append("(?:(?!(?:" if c == "!" else "(?:")
            open_.append(c)
            at += 2
            continue
        if c == ")" and open_:
            kind = open_.pop()
            out.append(")(?:/|\\z))[^/]*)" if kind == "!" else ")" + {"@": ""}.get(kind, kind))
            at += 1
            continue
        if c == "|" and open_:
            out.append("|")
            at += 1
            continue
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
            continue
        if glob.startswith("**", at) and (at == 0 or glob[at - 1] in "/({,|") and (at + 2 == len(glob) or glob[at + 2] in "/)},|"):  # a segment of its own crosses folders
            out.append(".*")
            at += 2
            continue
        if c == "{" and (ends := RANGE.match(glob, at)):
            out.append("(?:" + "|".join(map(re.escape, between(*ends.groups()))) + ")")
            at = ends.end()
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            to = at + 2 if glob[at + 1 : at + 2] in ("!", "^") else at + 1
            body, first = ["^"] if to > at + 1 else [], to
            while to < len(glob) and (glob[to] != "]" or to == first):  # a first ] and named classes are members
                named = NAMED.match(glob, to)
                body.append(CLASSES.get(named[1], "") if named else "\\" + glob[to] if glob[to] in "\\[]^&" else glob[to])
                to = named.end() if named else to + 1
            if to >= len(glob):
                raise ValueError(f"unclosed [ in {glob}")
            out.append(f"[{''.join(body)}]")
            at = to
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_ -" else c)
        at += 1
    if depth:
        raise ValueError(f"unclosed {{ in {glob}")
    if open_:
        raise ValueError(f"unclosed ( in {glob}")
    return "".join(out)


def literal_prefix(glob: str) -> str:
    return re.match(r"[^*?\[{!@+]*", glob)[0] if not glob.startswith("!") else ""


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits; no patterns fit nothing. Literal prefixes go in front, as those reach the scan."""
    tests = []
    for p in patterns:
        negated = p.startswith("!") and not p.startswith("!(")
        test = path.rlike(rf"(?s)\A(?:{to_regex(p.lstrip('!') if negated else p)})\z")
        prefix = literal_prefix(p)
        tests.append(~test if negated else path.startswith(prefix) & test if prefix else test)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def include(notes: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Notes that fit; all without patterns."""
    return notes.where(matches(F.col(path), patterns)) if patterns else notes


def exclude(notes: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    return notes.where(~matches(F.col(path), patterns))


#: Where the application keeps its own documents; a parameter of every function that uses it.
OWN_FOLDER = "goals/"


def own_folder(notes: DataFrame, folder: str = OWN_FOLDER, path: str = "path") -> DataFrame:
    """Notes outside the application's own folder."""
    return notes.where(~F.col(path).startswith(folder))


def select(notes: DataFrame, include_patterns: list[str], exclude_patterns: list[str], path: str = "path") -> DataFrame:
    """Include, then exclude, then the own folder."""
    return own_folder(exclude(include(notes, include_patterns, path), exclude_patterns, path), path=path)


def is_goal_document(path: Column, folder: str = OWN_FOLDER) -> Column:
    return path.rlike(rf"\A{re.escape(folder)}[^/]+/goal\.md\z")


def in_folder(path: Column, folder: str) -> Column:
    return path.startswith(folder.rstrip("/") + "/") & path.endswith(".md")
