"""URL filters: explicit rules, then a path-template tree per host.

Paths of a host are cut into segments. Level by level, a segment stays literal under its template when it has support and its share of bad pages differs from its parent's
beyond chance (a z-test over labelled pages); all others, variable segments and statistically similar branches alike, merge into ``*``. A branch goes on as long as it is live: its
labelled pages are of both kinds and enough to tell two children apart; below that every segment is ``*``, so paths may be of any depth. A template is rejected when its smoothed
purity, (good pages + 1) / (labelled pages + 2), is under one half. Labels are what the rules say of the pages they fit, unless labels are given; other pages are
unlabelled, and a host without labels allows all. Everything is grouped counts, which combine before the shuffle, and joins that can split hot hosts.

null urls and urls without ``://``: empty host and path (one tree of their own). Repeated urls and repeated rows count as pages each and get a verdict each; a null page_id is
kept. Other columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stage, table

#: (action, host, path start)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, Z_SQUARED = 5, 6.6564
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; nulls if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # later ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, good, bad) for ``paths(host, path, good, bad)`` (labelled pages of each kind), one row per host and path; a staged table."""
    parts = F.split(F.regexp_replace("path", r"\A/", ""), "/", -1)
    now = stage(paths.select("host", "path", "good", "bad", parts.alias("parts"), F.lit("").alias("template")), "paths")
    done, level = [], 0
    d = lambda c: F.col(c).cast("double")
    while True:
        part = F.get("parts", F.lit(level))
        child = now.where(F.size("parts") > level).groupBy("host", "template", part.alias("part")).agg(F.sum(F.col("good") + F.col("bad")).alias("cn"), F.sum("bad").alias("cb"))
        parent = child.groupBy("host", "template").agg(F.sum("cn").alias("pn"), F.sum("cb").alias("pb"))
        # written: few rows, and joins with them are of plain shuffles or broadcasts, so that hot hosts can be split
        live = stage(parent.where(f"pb > 0 and pb < pn and pn >= {2 * SUPPORT}"), "live")
        rest = now.join(live.select("host", "template", F.lit(True).alias("lives")), ["host", "template"], "left")
        ended = rest.where(F.col("lives").isNull()).withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("parts") - level, F.lit(0)))))
        done.append(stage(ended.select("host", "path", "template", "good", "bad"), "ended"))
        if not live.head(1):
            dropped(live, now)
            break
        apart = F.pow(d("cb") * d("pn") - d("pb") * d("cn"), 2) >= F.lit(Z_SQUARED) * d("pb") * (d("pn") - d("pb")) * d("cn")
        literal = stage(child.where(F.col("cn") >= SUPPORT).join(live, ["host", "template"]).where(apart).select("host", "template", "part", F.lit(True).alias("stays")), "literal")
        going = rest.where("lives").withColumn("part", part).join(literal, ["host", "template", "part"], "left")
        word = F.when(F.col("part").isNull(), F.lit("")).when(F.col("stays"), F.concat(F.lit("/"), "part")).otherwise(F.lit("/*"))
        then = stage(going.withColumn("template", F.concat("template", word)).select(now.columns), "paths")
        dropped(live, literal, now)
        now, level = then, level + 1
    out = stage(functools.reduce(DataFrame.unionAll, done), "templates")
    dropped(*done)
    return out


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for ``pages(page_id, url)``; ``labels(page_id, bad)`` may replace the rules as labels: bad wins where they differ, null bad is no label."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    if labels is None:
        known = rows.withColumn("is_bad", (F.col("action") == "block").cast("bigint"))
    else:
        given = stage(labels.where("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("bigint")).alias("is_bad")), "labels")
        known = rows.join(given, "page_id", "left")
    tree = templates(known.groupBy("host", "path").agg(F.count_if(F.col("is_bad") == 0).alias("good"), F.count_if(F.col("is_bad") == 1).alias("bad")))
    purity = stage(tree.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb")).select("host", "template", ((F.col("tg") + 1) / (F.col("tg") + F.col("tb") + 2)).alias("purity")), "purity")
    judged = stage(tree.join(purity, ["host", "template"]).select("host", "path", "template", "purity"), "judged")
    dropped(tree, purity)
    verdict = F.coalesce("action", F.when(F.col("purity") < 0.5, "block").otherwise("allow"))
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages"))


#: Levels that the SQL writes out; on the driver's tables no template lives beyond them.
SQL_LEVELS = 6


def _sql() -> str:
    fit = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2]))) + " END"
    pick = lambda what: fit.format(*[r[0] if what == "action" else r[1] + r[2] for r in RULES])
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), r AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), k AS (SELECT *, {pick("rule")} AS rule, {pick("action")} AS action FROM r
), t0 AS (SELECT host, path, count(*) FILTER (WHERE action = 'allow') AS good, count(*) FILTER (WHERE action = 'block') AS bad, string_split(regexp_replace(path, '^/', ''), '/') AS parts, '' AS template FROM k GROUP BY host, path
)"""
    for i in range(SQL_LEVELS):
        sql += f""", c{i} AS (SELECT host, template, parts[{i + 1}] AS part, sum(good + bad)::DOUBLE AS cn, sum(bad)::DOUBLE AS cb FROM t{i} WHERE len(parts) > {i} GROUP BY ALL
), p{i} AS (SELECT host, template, sum(cn) AS pn, sum(cb) AS pb FROM c{i} GROUP BY ALL HAVING pb > 0 AND pb < pn AND pn >= {2 * SUPPORT}
), l{i} AS (SELECT host, template, part FROM c{i} JOIN p{i} USING (host, template) WHERE cn >= {SUPPORT} AND pow(cb * pn - pb * cn, 2) >= {Z_SQUARED} * pb * (pn - pb) * cn
), t{i + 1} AS (SELECT t.host, path, good, bad, parts, concat(t.template, CASE WHEN len(parts) <= {i} THEN '' WHEN l.part IS NOT NULL THEN '/' || l.part ELSE '/*' END) AS template FROM t{i} t LEFT JOIN l{i} l ON l.host = t.host AND l.template = t.template AND l.part = parts[{i + 1}] AND len(parts) > {i}
)"""
    return (
        sql
        + f""", t AS (SELECT host, path, good, bad, concat(template, repeat('/*', greatest(len(parts) - {SQL_LEVELS}, 0))) AS template FROM t{SQL_LEVELS}
), q AS (SELECT host, template, (sum(good) + 1)::DOUBLE / (sum(good) + sum(bad) + 2) AS purity FROM t GROUP BY ALL)
SELECT page_id, k.host, k.path, rule, coalesce(action, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity FROM k JOIN t ON t.host = k.host AND t.path = k.path JOIN q ON q.host = t.host AND q.template = t.template"""
    )


OP9_SQL = _sql()
