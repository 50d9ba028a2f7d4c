"""Identifiers, dates as text, and checks of what users type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: How dates are shown, one pattern whatever the locale.
DATE = "MMM d, yyyy"
#: What the keys of providers look like: start and least length.
KEYS = {"anthropic": ("sk-ant-", 20), "voyage": ("", 10)}


def entity_id(prefix: str, *keys: Column) -> Column:
    """An identifier that follows from keys alone, as a UUID behind a prefix: retried tasks and repeated runs give the same one."""
    h = F.md5(F.to_json(F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)])).cast("binary"))
    return F.concat(F.lit(f"{prefix}-"), F.array_join(F.array(*[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), "-"))


def random_id(prefix: str) -> Column:
    """A random UUID behind a prefix; to be written before it is used twice."""
    return F.concat(F.lit(f"{prefix}-"), F.expr("uuid()"))


def timed_id(prefix: str, at: Column, ordinal: Column) -> Column:
    """A prefix, milliseconds and a place."""
    return F.concat(F.lit(f"{prefix}-"), F.unix_millis(at.cast("timestamp")).cast("string"), F.lit("-"), ordinal.cast("string"))


def date_text(c: Column) -> Column:
    return F.date_format(c, DATE)


def key_error(provider: str, key: Column) -> Column:
    """What is wrong with a provider's key, null if nothing: missing, prefix, short or space, the first that holds."""
    start, least = KEYS[provider]
    k = trim(F.coalesce(key, F.lit("")))
    return F.when(k == "", "missing").when(~k.startswith(start), "prefix").when(F.length(k) < least, "short").when(k.rlike(r"\s"), "space")
