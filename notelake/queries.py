"""The query catalogue over the driver's tables: each query with its SQL.

Notes are a markdown view of ``documents`` that both sides build from the same SQL. "Now" is a fixed time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, json, markdown, scores, text
from .operators import cache, clusters, documents, linkgraph, review, rollups, search
from .plans import providers, relevance
from .session import ship, stage
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOTES = """
SELECT doc_id AS seq, lang, source, concat(CASE WHEN doc_id % 19 = 0 THEN 'goals/' WHEN doc_id % 17 = 0 THEN 'templates/' WHEN doc_id % 23 = 0 THEN '.hidden/' ELSE '' END, source, '/', lang, '/Doc ', doc_id, '.md') AS path,
  concat('---', chr(10), 'title: Doc ', doc_id, chr(10), 'tags: [', lang, ', "', source, '"]', chr(10), 'rank: ', doc_id % 10, chr(10), '---', chr(10), '# Doc ', doc_id, chr(10), chr(10), chr(10), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('```python', chr(13), chr(10), 'x = "#no', doc_id, '"', chr(10), '```', chr(10)) ELSE concat('```', chr(10), 'plain', chr(10), '```', chr(10)) END,
    CASE WHEN doc_id % 5 = 0 THEN '![  a  picture ](img.png) ' WHEN doc_id % 5 = 1 THEN '![](b.png) <b>bold</b> [site](http://example.org/x) ' ELSE '' END,
    '#', lang, '/', source, ' [[Doc ', (doc_id * 7 + 1) % 1000, ']] ', CASE WHEN doc_id % 4 = 0 THEN concat('[[Doc ', (doc_id + 5) % 1000, '.md#part|alias]] [[#here]] [[', source, '/', lang, '/Doc ', doc_id, '.md]] ') ELSE '' END,
    CASE WHEN doc_id % 6 = 0 THEN concat('你好世界 `#code', doc_id, '` ') ELSE '' END, chr(10), '   indented', chr(9), ' text', chr(13), chr(10), '## Part ', doc_id % 3, chr(10), text) AS content
FROM documents"""
WITH_NOTES = f"WITH notes AS ({NOTES})"
#: White space for the oracle's regular expressions.
DWS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DCJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ac00}-\x{d7af}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
NOW = "2030-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes_of(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(NOTES.replace("FROM documents", "FROM {docs}"), docs=read(spark, sf, "documents"))


def now():
    return F.lit(NOW).cast("timestamp")


def d_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{DWS}+', ''), '{DWS}+$', '')"


def d_len(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def d_tokens(x: str) -> str:
    return f"(((2 * ({d_len(x)} - len(regexp_extract_all({x}, '{DCJK}'))) + 2) // 3) + len(regexp_extract_all({x}, '{DCJK}')))"


def d_named(x: str, pattern: str, label: str) -> str:
    one = f"concat('[{label}: ', coalesce(nullif({d_trim('l[i]')}, ''), '{label}'), ']')"
    put = f"array_to_string(list_transform(generate_series(1, len(p)), lambda i: concat(p[i], CASE WHEN i < len(p) THEN {one} ELSE '' END)), '')"
    return f"(SELECT {put} FROM (SELECT regexp_split_to_array(v, '{pattern}') AS p, regexp_extract_all(v, '{pattern}', 1) AS l FROM (SELECT {x} AS v)))"


def d_front(x: str) -> str:
    return rf"regexp_replace({x}, '\A---\r?\n[\s\S]*?---\r?\n?', '')"


def d_code(x: str) -> str:
    return d_named(x, r"```(\w*)\r?\n[\s\S]*?```", "code")


def d_images(x: str) -> str:
    return d_named(x, r"!\[([^\]]*)\]\([^)]+\)", "image")


def d_space(x: str) -> str:
    a = rf"regexp_replace(replace({x}, concat(chr(13), chr(10)), chr(10)), '\n{{3,}}', concat(chr(10), chr(10)), 'g')"
    return d_trim(rf"regexp_replace(regexp_replace({a}, '[ \t]+', ' ', 'g'), '(?m)^ +', '', 'g')")


def d_prepare(x: str) -> str:
    return d_space(d_images(d_code(d_front(x))))


def d_djb2(x: str) -> str:
    return f"printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295))"


def d_hash(x: str) -> str:
    flat = d_trim(f"regexp_replace({x}, '{DWS}+', ' ', 'g')")
    return d_djb2(f"concat(CASE WHEN length({flat}) <= 1500 THEN {flat} ELSE concat(left({flat}, 1000), right({flat}, 500)) END, ':', length({flat}))")


# --- vectors and scores ---


@query("SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity FROM embeddings v CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0")
def vec_dot_pairs(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.similarities(e, q).withColumn("similarity", F.round("similarity", 9))


TOPK = "SELECT v.vec_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 40"


def first_vector(e: DataFrame) -> list[float]:
    return [float(x) for x in e.where("vec_id = 0").first()["embedding"]]


@query(f"SELECT vec_id, round(similarity, 9) AS similarity FROM ({TOPK})")
def vec_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    return search.top_k(e, first_vector(e), 40).withColumn("similarity", F.round("similarity", 9))


@query("SELECT query_id, label, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.label, v.vec_id, row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings v CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 3")
def vec_topk_per_label(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_each(e, q, 3, ["label"]).select("query_id", "label", "vec_id", "rank")


SIMS = "SELECT event_id, value, (event_id % 500 - 250) / 200.0::DOUBLE AS s FROM events"


def sims(spark, sf):
    return read(spark, sf, "events").select("event_id", "value", ((F.col("event_id") % 500 - 250) / F.lit(200.0)).alias("s"))


@query(f"SELECT event_id, floor((greatest(least(s, 1.0), -1.0) + 1) / 2 * 100 + 0.5)::BIGINT AS score FROM ({SIMS})")
def score_from_similarity(spark, sf):
    return sims(spark, sf).select("event_id", scores.to_score(F.col("s")).alias("score"))


@query("SELECT event_id, greatest(least((event_id % 140 - 20)::DOUBLE, 100.0), 0.0) / 100 * 2 - 1 AS similarity FROM events")
def similarity_from_score(spark, sf):
    return read(spark, sf, "events").select("event_id", scores.to_similarity(F.col("event_id") % 140 - 20).alias("similarity"))


@query("SELECT event_id, CASE WHEN x >= 90 THEN 'excellent' WHEN x >= 70 THEN 'great' WHEN x >= 50 THEN 'good' ELSE 'needs-work' END AS session_band, CASE WHEN x >= 90 THEN 'excellent' WHEN x >= 70 THEN 'high' WHEN x >= 50 THEN 'medium' WHEN x >= 30 THEN 'low' ELSE 'minimal' END AS note_band FROM (SELECT event_id, event_id % 101 AS x FROM events)")
def score_bands(spark, sf):
    x = F.col("event_id") % 101
    return read(spark, sf, "events").select("event_id", scores.session_band(x).alias("session_band"), scores.note_band(x).alias("note_band"))


# --- paths and filters ---

INCLUDE, EXCLUDE = ["src*/en/**", "**/fr/Doc 1?.md", "src{1,2}/de/*.md"], ["templates/**", ".hidden/**", "**/*5.md"]
D_INCLUDE = r"regexp_full_match(path, 'src[^/]*/en/.*|(?:.*/)?fr/Doc 1[^/]\.md|src(?:1|2)/de/[^/]*\.md')"
D_EXCLUDE = r"regexp_full_match(path, 'templates/.*|\.hidden/.*|(?:.*/)?[^/]*5\.md')"


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE {D_INCLUDE}")
def path_include(spark, sf):
    return globs.include(notes_of(spark, sf), INCLUDE).select("path")


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE NOT {D_EXCLUDE}")
def path_exclude(spark, sf):
    return globs.exclude(notes_of(spark, sf), EXCLUDE).select("path")


@query(f"{WITH_NOTES} SELECT count(*) FILTER (WHERE {D_EXCLUDE}) AS excluded, count(*) AS total FROM notes")
def path_exclude_count(spark, sf):
    return notes_of(spark, sf).agg(F.count_if(globs.matches(F.col("path"), EXCLUDE)).alias("excluded"), F.count("*").alias("total"))


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE {D_INCLUDE} AND NOT {D_EXCLUDE} AND NOT starts_with(path, 'goals/')")
def own_folder_filter(spark, sf):
    return globs.select(notes_of(spark, sf), INCLUDE, EXCLUDE).select("path")


BLANKS = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(' ', chr(10), chr(9)) WHEN doc_id % 11 = 0 THEN '' ELSE text END AS t FROM documents"


@query(f"SELECT doc_id, {d_trim('t')} = '' AS is_empty, length(t) AS n FROM ({BLANKS})")
def empty_text_split(spark, sf):
    rows = spark.sql(BLANKS.replace("FROM documents", "FROM {docs}"), docs=read(spark, sf, "documents"))
    return rows.select("doc_id", text.is_blank(F.col("t")).alias("is_empty"), F.length("t").cast("bigint").alias("n"))


# --- text preparation ---


def _prepared_by(name: str, column, sql: str):
    def f(spark, sf):
        return notes_of(spark, sf).select("path", F.md5(column(F.col("content")).cast("binary")).alias("digest"), F.length(column(F.col("content"))).cast("bigint").alias("n"))

    f.__name__ = name
    query(f"{WITH_NOTES} SELECT path, md5({sql}) AS digest, length({sql}) AS n FROM notes")(f)


_prepared_by("strip_frontmatter", markdown.strip_frontmatter, d_front("content"))
_prepared_by("summarize_code", markdown.summarize_code, d_code("content"))
_prepared_by("strip_images", markdown.summarize_images, d_images("content"))
_prepared_by("normalize_ws", markdown.normalize_whitespace, d_space("content"))
_prepared_by("prepare_text", markdown.prepare, d_prepare("content"))
_prepared_by("preview", text.preview, f"CASE WHEN length(content) > 500 THEN concat({d_trim('left(content, 500)')}, '...') ELSE {d_trim('content')} END")


@query(f"{WITH_NOTES} SELECT path, {d_tokens('content')} AS tokens FROM notes")
def estimate_tokens(spark, sf):
    return notes_of(spark, sf).select("path", text.estimate_tokens(F.col("content")).alias("tokens"))


@query(f"{WITH_NOTES} SELECT path, ceil(ceil({d_len('content')} / 4.0) * 1.2::DOUBLE)::BIGINT AS tokens FROM notes")
def llm_tokens(spark, sf):
    return notes_of(spark, sf).select("path", text.estimate_model_tokens(F.col("content")).alias("tokens"))


@query(f"{WITH_NOTES} SELECT path, {d_hash('content')} AS content_hash FROM notes")
def content_hash(spark, sf):
    return notes_of(spark, sf).select("path", text.content_hash(F.col("content")).alias("content_hash"))


def _d_last(x: str, what: str, upto: str) -> str:
    head = f"left({x}, ({upto} + {len(what)})::INT)"
    lit = "concat(chr(10), chr(10))" if what == "\n\n" else f"'{what[::-1]}'"
    return f"(CASE WHEN instr(reverse({head}), {lit}) = 0 THEN -1 ELSE length({head}) - instr(reverse({head}), {lit}) - {len(what)} + 1 END)"


LETTERS = "etaoinsr"
EMBED_LIMIT = 8191


def _d_truncate(limit: int, source: str) -> str:
    """CTEs that cut ``t`` of ``source`` at ``limit`` tokens: the last one, s6, has the columns of the source and ``made``, the text as cut."""
    sql = f"p AS (SELECT *, {d_tokens('t')} AS n FROM {source}), q AS (SELECT *, floor(length(t) * ({limit}.0::DOUBLE / n) * 0.95::DOUBLE)::BIGINT AS target FROM p), s0 AS (SELECT *, {_d_last('t', chr(10) * 2, 'target')} AS para, {_d_last('t', ' ', 'target')} AS word, -1 AS best FROM q)"
    for i, e in enumerate([". ", "! ", "? ", "。", "！", "？"]):
        sql += f", s{i + 1} AS (SELECT * EXCLUDE (best), CASE WHEN {_d_last('t', e, 'target')} > best THEN {_d_last('t', e, 'target')} + {len(e)} ELSE best END AS best FROM s{i})"
    cut = "CASE WHEN para > target * 0.7 THEN para WHEN best > target * 0.7 THEN best WHEN word > target * 0.8 THEN word ELSE target END"
    made = f"CASE WHEN n <= {limit} THEN t ELSE concat({d_trim(f'left(t, ({cut})::INT)')}, chr(10), chr(10), '[content truncated]') END"
    return sql + f", made AS (SELECT * EXCLUDE (n, target, para, word, best), {made} AS made FROM s6)"


@query(f"{WITH_NOTES}, own AS (SELECT path, content AS t FROM notes), {_d_truncate(400, 'own')} SELECT path, md5(made) AS digest, contains(made, '[content truncated]') AS was_truncated FROM made")
def truncate_tokens(spark, sf):
    t = text.truncate(F.col("content"), 400)
    return notes_of(spark, sf).select("path", t.alias("t")).select("path", F.md5(F.col("t").cast("binary")).alias("digest"), text.was_truncated(F.col("t")).alias("was_truncated"))


# --- metadata and links ---

D_TAGS = r"""list_distinct(list_concat(['#' || lang, '#' || source], list_transform(regexp_extract_all(concat(' ', regexp_replace(regexp_replace(content, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g')), '(?:^|[^`\w])#([a-zA-Z][a-zA-Z0-9_/-]*)', 1), lambda x: '#' || x)))"""
D_LINKS = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1), lambda x: CASE WHEN starts_with({d_trim("x")}, '#') THEN '' ELSE string_split({d_trim("x")}, '#')[1] END), lambda x: x <> ''))"""


@query(f"{WITH_NOTES} SELECT path, unnest({D_TAGS}) AS tag FROM notes")
def note_tags(spark, sf):
    return notes_of(spark, sf).select("path", F.explode(markdown.tags(F.col("content"))).alias("tag"))


@query(f"{WITH_NOTES} SELECT DISTINCT tag FROM (SELECT unnest({D_TAGS}) AS tag FROM notes)")
def all_tags(spark, sf):
    return linkgraph.all_tags(notes_of(spark, sf)).orderBy("tag")


@query(f"{WITH_NOTES} SELECT path AS source, unnest({D_LINKS}) AS link FROM notes")
def note_links(spark, sf):
    return linkgraph.raw_links(notes_of(spark, sf))


@query(rf"""{WITH_NOTES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM notes)
SELECT path, {d_trim("regexp_extract(x, '^(#{1,6})' || chr(32) || '+([^\\n\\r]+)$', 2)".replace(chr(92) * 2, chr(92)))} AS heading, length(regexp_extract(x, '^(#{{1,6}})', 1)) AS level, line FROM l WHERE regexp_full_match(x, '#{{1,6}}\s+[^\n\r]+')""")
def note_headings(spark, sf):
    rows = notes_of(spark, sf).select("path", F.explode(markdown.headings(F.col("content"))).alias("h"))
    return rows.select("path", "h.heading", "h.level", "h.line")


@query(rf"""{WITH_NOTES} SELECT path, len(regexp_extract_all(regexp_replace(regexp_replace(content, '\A---\r?\n[\s\S]*?\r?\n---\r?\n?', ''), '```[\s\S]*?```', '', 'g'), '[^{DWS[1:]}+')) AS words FROM notes""")
def word_count_plain(spark, sf):
    return notes_of(spark, sf).select("path", markdown.count_words(F.col("content")).alias("words"))


def _d_words() -> str:
    x = "content"
    for p, to, g in ((r"\A---[\s\S]*?---\n?", "", ""), (r"```[\s\S]*?```", "", ", 'g'"), (r"`[^`]+`", "", ", 'g'"), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", r"\1", ", 'g'"), (r"\[([^\]]+)\]\([^)]+\)", r"\1", ", 'g'"), (r"<[^>]+>", "", ", 'g'")):
        x = f"regexp_replace({x}, '{p}', '{to}'{g})"
    cjk = DCJK.replace(r"\x{3400}-\x{4dbf}", "")
    return f"{WITH_NOTES}, c AS (SELECT path, {x} AS t FROM notes) SELECT path, len(list_filter(regexp_split_to_array(t, '[{DWS[1:-1]}\\p{{P}}]+'), lambda w: regexp_matches(w, '[a-zA-Z]'))) + len(regexp_extract_all(t, '{cjk}')) AS words FROM c"


@query(_d_words())
def word_count_cjk(spark, sf):
    return notes_of(spark, sf).select("path", markdown.count_words_and_cjk(F.col("content")).alias("words"))


@query(f"{WITH_NOTES} SELECT path, concat('Doc ', seq) AS title, concat('[', lang, ', \"', source, '\"]') AS tags, (seq % 10)::VARCHAR AS rank, 3 AS n FROM notes")
def frontmatter_map(spark, sf):
    f = markdown.frontmatter(F.col("content"))
    return notes_of(spark, sf).select("path", f.alias("f")).select("path", *[F.col("f")[k].alias(k) for k in ("title", "tags", "rank")], F.size("f").alias("n"))


D_RESOLVED = f"""{WITH_NOTES}, raw AS (SELECT path AS source, unnest({D_LINKS}) AS link FROM notes
), b AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^/.]+$', '') AS b, arg_min(path, (length(path), seq)) AS by_name FROM notes GROUP BY 1
), r AS (SELECT raw.source, coalesce(e.path, m.path, b.by_name) AS target FROM raw LEFT JOIN notes e ON e.path = link LEFT JOIN notes m ON m.path = link || '.md' LEFT JOIN b ON b.b = link
), edges AS (SELECT source, target, count(*) AS n FROM r WHERE target IS NOT NULL GROUP BY 1, 2)"""


@query(f"{D_RESOLVED} SELECT source, target, n FROM edges")
def resolved_links(spark, sf):
    return linkgraph.resolved(notes_of(spark, sf))


@query(f"{D_RESOLVED} SELECT target, source FROM edges")
def backlinks(spark, sf):
    return linkgraph.backlinks(linkgraph.resolved(notes_of(spark, sf)))


@query(f"{D_RESOLVED} SELECT target, count(DISTINCT source) AS n_sources, sum(n)::BIGINT AS n_links FROM edges GROUP BY 1")
def inlink_counts(spark, sf):
    return linkgraph.inlinks(linkgraph.resolved(notes_of(spark, sf)))


# --- cache and embedding ---

D_READY = f"{WITH_NOTES}, p AS (SELECT seq, path, content, {d_prepare('content')} AS t FROM notes), h AS (SELECT seq, path, {d_hash('content')} AS content_hash, {d_tokens('t')} AS tokens FROM p)"


def ready(spark, sf) -> DataFrame:
    """Notes with the hash of their whole content and the tokens of what is sent of them, written once."""
    t = text.estimate_tokens(markdown.prepare(F.col("content")))
    return stage(notes_of(spark, sf).select("seq", "path", text.content_hash(F.col("content")).alias("content_hash"), t.alias("estimated_tokens")), "ready")


def cached(rows: DataFrame) -> DataFrame:
    """A cache in which every third note is current and every fifth is stale."""
    return rows.where("seq % 3 = 0 or seq % 5 = 0").select("path", F.when(F.col("seq") % 3 == 0, F.col("content_hash")).otherwise("00000000").alias("content_hash"), F.array(F.col("seq").cast("float")).alias("embedding"))


@query(f"{D_READY} SELECT path, seq % 3 = 0 AS from_cache FROM h")
def cache_split(spark, sf):
    rows = ready(spark, sf)
    return cache.split(rows, cached(rows)).select("path", "from_cache")


@query(f"{D_READY} SELECT path, content_hash FROM h WHERE seq % 3 <> 0")
def changed_notes(spark, sf):
    rows = ready(spark, sf)
    return cache.changed(rows, cached(rows)).select("path", "content_hash")


@query(f"{D_READY}, s AS (SELECT count(*) FILTER (WHERE seq % 3 = 0) AS hits, count(*) FILTER (WHERE seq % 3 <> 0) AS misses, count(*) AS notes, sum(CASE WHEN seq % 3 <> 0 THEN tokens END)::BIGINT AS tokens FROM h) SELECT *, ceil(misses / 128.0)::BIGINT AS api_calls, tokens::DOUBLE / 1000000 * 0.02::DOUBLE AS cost FROM s")
def embed_stats(spark, sf):
    rows = ready(spark, sf)
    return cache.stats(cache.split(rows, cached(rows)), 128, 0.02)


@query(f"{D_READY}, b AS (SELECT seq // 128 AS batch, tokens, CASE WHEN seq % 4 = 0 THEN NULL ELSE tokens + 1 END AS reported FROM h) SELECT batch, count(*) AS n, sum(coalesce(reported, tokens))::BIGINT AS tokens FROM b GROUP BY 1")
def batch_tokens(spark, sf):
    rows = ready(spark, sf).select(F.floor(F.col("seq") / 128).alias("batch"), F.col("estimated_tokens").alias("t"), F.when(F.col("seq") % 4 != 0, F.col("estimated_tokens") + 1).alias("reported"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.coalesce("reported", "t")).alias("tokens"))


@query("WITH u AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'voyage-3.5-lite' WHEN 1 THEN 'voyage-3.5' WHEN 2 THEN 'text-embedding-3-large' ELSE 'unknown' END AS model, (event_id % 1000) * 1000 AS tokens FROM events) SELECT event_id, model, CASE model WHEN 'voyage-3.5' THEN 1024 WHEN 'voyage-3.5-lite' THEN 1024 WHEN 'text-embedding-3-large' THEN 3072 ELSE 1536 END AS dims, tokens::DOUBLE / 1000000 * (CASE model WHEN 'voyage-3.5' THEN 0.06 WHEN 'text-embedding-3-large' THEN 0.13 ELSE 0.02 END)::DOUBLE AS cost FROM u")
def embed_cost(spark, sf):
    m = F.col("event_id") % 4
    name = F.when(m == 0, "voyage-3.5-lite").when(m == 1, "voyage-3.5").when(m == 2, "text-embedding-3-large").otherwise("unknown")
    return providers.priced(read(spark, sf, "events").select("event_id", name.alias("model"), (F.col("event_id") % 1000 * 1000).alias("tokens"))).select("event_id", "model", "dims", "cost")


def _d_vector(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


D_EMBEDDED = f"{WITH_NOTES}, own AS (SELECT path, seq, content, {d_prepare('content')} AS t FROM notes WHERE NOT starts_with(path, 'goals/')), {_d_truncate(EMBED_LIMIT, 'own')}, e AS (SELECT path, seq, content, made, {_d_vector('made')} AS v, {d_tokens('made')} AS tokens FROM made WHERE {d_trim('made')} <> ''), u AS (SELECT path, seq, content, tokens, list_transform(v, lambda x: (x / (CASE WHEN list_dot_product(v, v) = 0 THEN 1.0::DOUBLE ELSE sqrt(list_dot_product(v, v)) END))::FLOAT) AS embedding FROM e)"


@query(f"{D_EMBEDDED} SELECT path, {d_hash('content')} AS content_hash, false AS from_cache, tokens AS token_count, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 5) AS weighed FROM u")
def embed_pipeline(spark, sf):
    """A cold run of the whole embedding plan with a provider that SQL can follow."""
    empty = spark.createDataFrame([], "path string, content_hash string, embedding array<float>")
    made = relevance.embedded(globs.own_folder(notes_of(spark, sf)), empty, providers.LetterEmbeddings(LETTERS))
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return made.select("path", "content_hash", "from_cache", "token_count", F.round(weighed, 5).alias("weighed"))


# --- relevance ---

CANDIDATES = f"{WITH_NOTES}, top AS ({TOPK}), c AS (SELECT n.path, n.seq, n.content, similarity FROM top JOIN notes n ON n.seq = top.vec_id)"
FENCE = "concat('Scores:', chr(10), '```json', chr(10), {body}, chr(10), '```')"
REPLY = "SELECT seq, path, CASE WHEN seq % 7 = 0 THEN concat('[{{\"notePath\": \"', path) WHEN seq % 5 = 0 THEN concat('[{{\"notePath\":\"', path, '\",\"score\":\"85\",\"reason\":\"text\"}}]') ELSE concat('[{{\"notePath\":\"', path, '\",\"score\":', seq % 130, ',\"reason\":\"first\"}},{{\"notePath\":\"', path, '\",\"score\":', seq % 97 + 0.5, ',\"reason\":\"r', seq, '\"}}]') END AS body FROM {table}"


def candidates(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings")
    best = search.top_k(e, first_vector(e), 40)
    return best.join(notes_of(spark, sf), F.col("vec_id") == F.col("seq")).select("path", "seq", "content", "similarity", text.preview(F.col("content")).alias("preview"))


def replies(rows: DataFrame) -> DataFrame:
    made = rows.sparkSession.sql(REPLY.replace("{table}", "{rows}"), rows=rows)
    return json.scores(made.select("seq", F.concat(F.lit("Scores:\n```json\n"), "body", F.lit("\n```")).alias("response")))


D_SCORES = "replies AS (" + REPLY.replace("{{", "{").replace("}}", "}").replace("{table}", "c") + "), s AS (SELECT path AS note_path, (seq % 97 + 0.5)::DOUBLE AS score, concat('r', seq) AS reason FROM replies WHERE seq % 7 <> 0 AND seq % 5 <> 0)"
D_SIM = "floor((greatest(least(similarity, 1.0), -1.0) + 1) / 2 * 100 + 0.5)::DOUBLE"


@query(f"{CANDIDATES} SELECT path, {D_SIM}::BIGINT AS score, '{relevance.REASON}' AS reason FROM c")
def relevance_no_llm(spark, sf):
    return candidates(spark, sf).select("path", scores.to_score(F.col("similarity")).alias("score"), F.lit(relevance.REASON).alias("reason"))


@query(f"{CANDIDATES}, {D_SCORES} SELECT c.path, coalesce(s.score, {D_SIM}) AS score, coalesce(s.reason, '{relevance.REASON}') AS reason FROM c LEFT JOIN s ON s.note_path = c.path")
def relevance_rerank(spark, sf):
    c = candidates(spark, sf)
    return relevance.ranked(relevance.merged(c, replies(c))).select("path", "score", "reason")


ALL_C = f"{WITH_NOTES}, c AS (SELECT path, seq, content FROM notes WHERE NOT starts_with(path, 'goals/'))"


@query(f"{ALL_C}, {D_SCORES} SELECT path, score, reason FROM s JOIN c ON c.path = s.note_path UNION ALL SELECT path, least(seq % 130, 100)::DOUBLE, 'first' FROM c WHERE seq % 7 <> 0 AND seq % 5 <> 0")
def relevance_llm_only(spark, sf):
    rows = globs.own_folder(notes_of(spark, sf))
    return relevance.by_model_only(rows, replies(rows).drop("seq", "pos")).select("path", "score", "reason")


@query(f"{CANDIDATES}, {D_SCORES} SELECT path FROM (SELECT c.path, coalesce(s.score, {D_SIM}) AS score FROM c LEFT JOIN s ON s.note_path = c.path) WHERE score >= 70")
def autoselect(spark, sf):
    c = candidates(spark, sf)
    return relevance.autoselected(relevance.merged(c, replies(c))).select("path")


# --- goals ---


def milestones(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("goal_id"), F.col("l_linenumber").alias("milestone_id"), (F.col("l_linestatus") == "F").alias("completed"))


@query("SELECT l_orderkey AS goal_id, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS total, floor(count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS percent, count(*) FILTER (WHERE l_linestatus = 'F') = count(*) AS all_completed FROM lineitem GROUP BY 1")
def goal_progress(spark, sf):
    return rollups.goal_progress(milestones(spark, sf))


@query("SELECT l_orderkey AS goal_id, count(*) AS n, true AS completed FROM lineitem GROUP BY 1")
def goal_complete_all(spark, sf):
    held = milestones(spark, sf).groupBy("goal_id").agg(F.collect_list(F.struct("milestone_id", "completed")).alias("m"))
    done = held.select("goal_id", rollups.complete_all(F.col("m")).alias("m"))
    return done.select("goal_id", F.size("m").cast("bigint").alias("n"), F.forall("m", lambda x: x["completed"]).alias("completed"))


GOALS = "SELECT o_orderkey AS goal_id, [concat('n', o_orderkey % 7), concat('n', o_orderkey % 5), concat('n', o_orderkey % 7)] AS notes_paths FROM orders"


def goals(spark, sf) -> DataFrame:
    n = lambda k: F.concat(F.lit("n"), F.col("o_orderkey") % k)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"), F.array(n(7), n(5), n(7)).alias("notes_paths"))


@query("SELECT goal_id, array_to_string(list_reduce(list_prepend([], list_transform(list_concat(notes_paths, ['n1', 'n9']), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END), ',') AS notes FROM (" + GOALS + ")")
def goal_notes_add(spark, sf):
    return rollups.add_notes(goals(spark, sf), F.array(F.lit("n1"), F.lit("n9"))).select("goal_id", F.array_join("notes_paths", ",").alias("notes"))


@query("SELECT goal_id, array_to_string(list_filter(notes_paths, lambda x: x NOT IN ('n1', 'n2')), ',') AS notes FROM (" + GOALS + ")")
def goal_notes_remove(spark, sf):
    return rollups.remove_notes(goals(spark, sf), F.array(F.lit("n1"), F.lit("n2"))).select("goal_id", F.array_join("notes_paths", ",").alias("notes"))


@query(f"SELECT doc_id, concat_ws(',', CASE WHEN {d_trim('name')} = '' THEN 'name' END, CASE WHEN length(name) > 200 THEN 'name too long' END, CASE WHEN regexp_matches(name, '[\\x00-\\x1F\\x7F]') THEN 'control characters' END, CASE WHEN doc_id % 6 = 0 THEN 'description' END, CASE WHEN doc_id % 8 = 0 THEN 'milestones' END) AS errors FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 3 = 0 THEN concat_ws(' ', 'Learn', lang, source) ELSE text END AS name FROM documents)")
def goal_validation(spark, sf):
    d = read(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.lit("Learn"), "lang", "source")).otherwise(F.col("text"))
    description, stones = F.when(F.col("doc_id") % 6 == 0, " ").otherwise("d"), F.when(F.col("doc_id") % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m")))
    return d.select("doc_id", F.array_join(rollups.goal_errors(name, description, F.lit("2030-01-01"), stones), ",").alias("errors"))


# --- conversations ---


def talk(spark, sf) -> DataFrame:
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


D_TOPIC = f"CASE WHEN f IS NULL THEN 'New Discussion' WHEN length({d_trim('f')}) <= 50 THEN {d_trim('f')} WHEN {_d_last(d_trim('f'), ' ', '50')} > 20 THEN concat(left({d_trim('f')}, ({_d_last(d_trim('f'), ' ', '50')})::INT), '...') ELSE concat(left({d_trim('f')}, 50), '...') END"
D_TALK = "SELECT conv_id AS conversation_id, count(*) AS messages, arg_min(text, turn) FILTER (WHERE role = 'user') AS f, max(turn) AS last_seq, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_content FROM conversations GROUP BY 1"


@query(f"SELECT conversation_id, messages, {D_TOPIC} AS topic, last_seq, last_role FROM ({D_TALK})")
def conversation_list(spark, sf):
    return rollups.conversation_list(talk(spark, sf)).drop("last_content")


@query(f"SELECT conv_id AS conversation_id, turn AS seq, {D_TOPIC} AS topic FROM (SELECT conv_id, turn, text AS f FROM conversations WHERE role = 'user')")
def conversation_topic(spark, sf):
    return talk(spark, sf).where("role = 'user'").select("conversation_id", "seq", rollups.topic(F.col("content")).alias("topic"))


@query("SELECT conv_id AS conversation_id, turn AS seq, role, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 2 = 0 THEN 'edited' ELSE text END AS content FROM conversations")
def last_message(spark, sf):
    t = talk(spark, sf)
    new = t.where("conversation_id % 2 = 0").select("conversation_id").distinct().withColumn("content", F.lit("edited"))
    return documents.replace_last(t, new)


@query("SELECT DISTINCT a.conv_id * 1000 + a.turn AS answer_id, n.path FROM conversations a JOIN (SELECT DISTINCT conv_id, concat('lib/', split_part(lower(text), ' ', 2), '.md') AS path, split_part(lower(text), ' ', 2) AS name FROM conversations WHERE role = 'user') n ON n.conv_id = a.conv_id AND (contains(a.text, n.path) OR contains(lower(a.text), n.name)) WHERE a.role = 'assistant'")
def message_sources(spark, sf):
    """Every conversation is about notes that its user's turns name; answers are searched for those."""
    t = talk(spark, sf)
    word = F.split_part(F.lower("content"), F.lit(" "), F.lit(2))
    notes = t.where("role = 'user'").select("conversation_id", F.concat(F.lit("lib/"), word, F.lit(".md")).alias("path")).distinct()
    answers = t.where("role = 'assistant'").select((F.col("conversation_id") * 1000 + F.col("seq")).alias("answer_id"), "conversation_id", F.col("content").alias("text"))
    return rollups.message_sources(answers, notes, "conversation_id")


@query("SELECT goal_id, md5(string_agg(concat('## ', doc_id, chr(10), chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY doc_id::VARCHAR)) AS digest FROM (SELECT doc_id // 8 AS goal_id, doc_id, coalesce(text, '') AS text FROM documents) GROUP BY 1")
def prompt_context(spark, sf):
    """Goals have eight notes each; a goal's context holds their whole texts."""
    d = read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 8).alias("goal_id"), F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    return rollups.prompt_context(d, "goal_id", "path", "body").select("goal_id", F.md5(F.col("context").cast("binary")).alias("digest"))


# --- quizzes ---

QUIZ = "q AS (SELECT l_orderkey AS session_id, l_linenumber AS question_id FROM lineitem), a AS (SELECT l_orderkey AS session_id, l_linenumber AS question_id, l_returnflag = 'N' AS is_correct FROM lineitem WHERE l_partkey % 4 <> 0)"


def quiz(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("question_id"), F.col("l_linenumber").alias("ordinal"), (F.col("l_returnflag") == "N").alias("is_correct"), "l_partkey")
    return rows.select("session_id", "question_id", "ordinal"), rows.where("l_partkey % 4 <> 0").select("session_id", "question_id", "is_correct")


D_QUIZ = f"WITH {QUIZ}, o AS (SELECT session_id, question_id, max(is_correct) AS is_correct FROM a GROUP BY 1, 2), j AS (SELECT q.session_id, count(*) AS total, count(o.is_correct) AS answered, count(*) FILTER (WHERE o.is_correct) AS correct FROM q LEFT JOIN o USING (session_id, question_id) GROUP BY 1)"


@query(f"{D_QUIZ} SELECT session_id, floor(100.0 * correct / total + 0.5)::BIGINT AS score, answered = total AS completed FROM j")
def qa_score(spark, sf):
    return rollups.quiz_scores(*quiz(spark, sf)).select("session_id", "score", "completed")


@query(f"{D_QUIZ} SELECT session_id, total, correct, total - correct AS incorrect, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 70 THEN 'great' WHEN s >= 50 THEN 'good' ELSE 'needs-work' END AS band FROM (SELECT *, floor(100.0 * correct / total + 0.5) AS s FROM j)")
def qa_summary(spark, sf):
    return rollups.quiz_scores(*quiz(spark, sf)).select("session_id", "total", "correct", "incorrect", "band")


@query(f"WITH {QUIZ} SELECT q.session_id, coalesce(min(question_id) FILTER (WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.session_id = q.session_id AND a.question_id = q.question_id)), count(*))::BIGINT AS position FROM q GROUP BY 1")
def qa_first_unanswered(spark, sf):
    return rollups.first_unanswered(*quiz(spark, sf)).select("session_id", F.col("position").cast("bigint").alias("position"))


ASKED = "concat('```json', chr(10), '{{\"questions\":[{{\"type\":\"multiple-choice\",\"text\":\"Q', doc_id, '\",\"sourceNotePath\":\"', lang, '.md\",\"options\":[\"a\",\"b\",\"c\"', CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',\"d\"' END, '],\"correctAnswer\":', CASE WHEN doc_id % 5 = 0 THEN '\"1\"' ELSE (doc_id % 6)::VARCHAR END, '}},{{\"type\":\"open-ended\",\"text\":\"', CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Why' END, '\",\"sourceNotePath\":\"', CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE 'en.md' END, '\"}}]}}', CASE WHEN doc_id % 11 = 0 THEN ',' ELSE '' END, chr(10), '```')"


@query(
    "SELECT doc_id, 0 AS pos, 'multiple-choice' AS type, concat('notes/', lang, '.md') AS source_note_path, doc_id % 6 AS correct FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 6 <= 3 UNION ALL SELECT doc_id, 1, 'open-ended', 'notes/en.md', -1 FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 4 <> 0 AND doc_id % 7 <> 0"
)
def qa_parse_questions(spark, sf):
    made = spark.sql("SELECT doc_id, " + ASKED.replace("(doc_id % 6)::VARCHAR", "cast(doc_id % 6 as string)") + " AS response FROM {docs}", docs=read(spark, sf, "documents"))
    known = F.array(*[F.lit(f"notes/{x}.md") for x in ("de", "en", "es", "fr")])
    return json.questions(made, "response", ["doc_id"], known).select("doc_id", "pos", "type", "source_note_path", F.coalesce(F.col("correct_answer").cast("bigint"), F.lit(-1)).alias("correct"))


@query("SELECT event_id, event_id % 4 = event_id % 3 AS is_correct, CASE WHEN event_id % 4 = event_id % 3 THEN 'Correct! This answer demonstrates understanding of the concept.' ELSE concat('Incorrect. The correct answer was: ', ['a', 'b', 'c'][event_id % 3 + 1]) END AS explanation FROM events")
def mc_grade(spark, sf):
    g = json.grade(F.col("event_id") % 4, F.col("event_id") % 3, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return read(spark, sf, "events").select("event_id", g.alias("g")).select("event_id", "g.*")


DRAFT = "concat('Plan', chr(10), '```json', chr(10), '{{\"name\":\" Learn ', doc_id, ' \",\"description\":\"', CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'd' END, '\",\"deadline\":', CASE WHEN doc_id % 7 = 0 THEN '5' ELSE '\"2030-01-01\"' END, ',\"milestones\":[', CASE WHEN doc_id % 3 = 0 THEN '' ELSE '\" one \",\"two\"' END, CASE WHEN doc_id % 11 = 1 THEN ',3' ELSE '' END, ']}}', chr(10), '```')"


@query("SELECT doc_id, concat('Learn ', doc_id) AS name, 'one|two' AS milestones FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 1")
def goal_draft_parse(spark, sf):
    made = spark.sql("SELECT doc_id, " + DRAFT + " AS response FROM {docs}", docs=read(spark, sf, "documents"))
    return made.select("doc_id", json.goal_draft(F.col("response")).alias("g")).where("g is not null").select("doc_id", "g.name", F.array_join("g.milestones", "|").alias("milestones"))


VERDICT = "CASE WHEN doc_id % 7 = 0 THEN 'no block' WHEN doc_id % 5 = 0 THEN concat('```json', chr(10), '{{\"isCorrect\":', chr(10), '```') ELSE concat('```json', chr(10), '{{\"isCorrect\":', CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"yes\"' ELSE '0' END, ',\"explanation\":\"', CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'because' END, '\"}}', chr(10), '```') END"


@query("SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 IN (0, 2) AS is_correct, CASE WHEN doc_id % 7 = 0 THEN 'Unable to evaluate answer. Please try again.' WHEN doc_id % 5 = 0 THEN 'Error evaluating answer. Please try again.' WHEN doc_id % 3 = 0 THEN 'No explanation provided.' ELSE 'because' END AS explanation FROM documents")
def eval_parse(spark, sf):
    made = spark.sql("SELECT doc_id, " + VERDICT + " AS response FROM {docs}", docs=read(spark, sf, "documents"))
    return made.select("doc_id", json.evaluation(F.col("response")).alias("e")).select("doc_id", "e.*")


# --- streams ---

SSE = "SELECT conv_id AS stream_id, turn AS seq, CASE WHEN turn = 0 THEN concat('data: {{\"type\":\"message_start\",\"message\":{{\"usage\":{{\"input_tokens\":', length(text), '}}}}}}') WHEN turn % 5 = 4 THEN concat('data: {{\"type\":\"message_delta\",\"usage\":{{\"output_tokens\":', turn, '}}}}') WHEN turn % 5 = 3 AND conv_id % 3 = 0 THEN 'data: {{broken' ELSE concat('data: {{\"type\":\"content_block_delta\",\"delta\":', to_json(named_struct('type', 'text_delta', 'text', coalesce(text, ''))), '}}') END AS line FROM {table}"


@query("WITH e AS (SELECT conv_id, turn, text, CASE WHEN turn = 0 THEN 's' WHEN turn % 5 = 4 THEN 'd' WHEN turn % 5 = 3 AND conv_id % 3 = 0 THEN 'x' ELSE 't' END AS k FROM conversations) SELECT conv_id AS stream_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE k = 't'), '') AS content, coalesce(arg_max(length(text), turn) FILTER (WHERE k = 's'), 0) AS input_tokens, coalesce(max(turn) FILTER (WHERE k = 'd'), 0) AS output_tokens, count(*) FILTER (WHERE k = 'x') AS errors, count(*) FILTER (WHERE k = 'x') >= 5 AS failed FROM e GROUP BY 1")
def token_fold(spark, sf):
    return events.fold(spark.sql(SSE.replace("{table}", "{t}"), t=read(spark, sf, "conversations")))


@query("SELECT event_id, user_id, n AS in_window, n < 10 AS allowed, CASE WHEN n >= 10 THEN (f + 7200000000 - t) / 1000000.0::DOUBLE ELSE 0.0 END AS wait_seconds FROM (SELECT event_id, user_id, t, count(*) OVER w AS n, min(t) OVER w AS f FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW))")
def rate_limit_window(spark, sf):
    return events.rate_window(read(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", seconds=7200).select("event_id", "user_id", "in_window", "allowed", "wait_seconds")


# --- review and clusters, from the specification ---

D_ANSWERS = "ans AS (SELECT user_id AS note_id, event_id, ts, value > 50 AS correct FROM events)"
D_HISTORY = f"{D_ANSWERS}, hw AS (SELECT *, (ts, event_id) AS o, max(CASE WHEN NOT correct THEN (ts, event_id) END) OVER (PARTITION BY note_id) AS w FROM ans), hist AS (SELECT note_id, min(ts) AS first_quizzed, max(ts) AS last_quizzed, count(*) AS quiz_count, count(*) FILTER (WHERE correct) AS correct_count, count(*) FILTER (WHERE w IS NULL OR o > w) AS streak FROM hw GROUP BY 1)"
D_NOW = "(SELECT max(ts) FROM events)"


def answers(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(F.col("user_id").alias("note_id"), "event_id", "ts", (F.col("value") > 50).alias("correct"))


def at_last(spark, sf):
    return F.lit(read(spark, sf, "events").agg(F.max("ts")).first()[0])


@query(f"WITH {D_HISTORY} SELECT note_id, first_quizzed, last_quizzed, quiz_count, correct_count, streak, least(quiz_count, 10) AS n_recent FROM hist")
def note_history(spark, sf):
    return review.note_history(answers(spark, sf)).withColumn("n_recent", F.size("recent").cast("bigint")).drop("recent")


D_DAYS = f"(epoch_us({D_NOW}) - epoch_us(last_quizzed)) / 86400000000.0::DOUBLE"


@query(f"WITH {D_HISTORY} SELECT note_id, {D_DAYS} >= [1, 3, 7, 14, 30, 60, 120][least(streak, 6) + 1] AS due, NOT ((streak > 5 AND {D_DAYS} < 14) OR {D_DAYS} < 1) AS quizzable FROM hist")
def due_notes(spark, sf):
    n = at_last(spark, sf)
    return review.note_history(answers(spark, sf)).select("note_id", review.is_due(F.col("last_quizzed"), F.col("streak"), n).alias("due"), review.should_quiz(F.col("last_quizzed"), F.col("streak"), n).alias("quizzable"))


@query(f"WITH {D_HISTORY}, x AS (SELECT *, {D_DAYS} AS days, {D_DAYS} - [1, 3, 7, 14, 30, 60, 120][least(streak, 6) + 1] AS over, correct_count::DOUBLE / quiz_count AS acc FROM hist), f AS (SELECT note_id, CASE WHEN over > 30 THEN 0.95 WHEN over > 7 THEN 0.85 WHEN over > 0 THEN 0.70 WHEN over > -3 THEN 0.50 ELSE 0.20 END::DOUBLE AS spaced, least(1.0, (note_id % 9) * 0.15)::DOUBLE * 0.6 + least(1.0, (note_id % 1500) / 1000.0)::DOUBLE * 0.4 AS rich, CASE WHEN days < 7 THEN 1.0 WHEN days < 30 THEN 0.7 WHEN days < 90 THEN 0.5 ELSE 0.1 END::DOUBLE AS recent, CASE WHEN quiz_count <= 2 THEN 0.9 WHEN quiz_count <= 5 THEN 0.7 WHEN quiz_count <= 10 THEN 0.5 ELSE 0.2 END::DOUBLE AS varied, CASE WHEN acc < 0.3 THEN 1.0 WHEN acc < 0.5 THEN 0.8 WHEN acc < 0.7 THEN 0.5 ELSE 0.1 END::DOUBLE AS hard FROM x) SELECT note_id, spaced, recent, varied, hard, round(spaced * 0.35 + rich * 0.2 + recent * 0.15 + varied * 0.15 + hard * 0.15, 6) AS total FROM f")
def quiz_scores(spark, sf):
    n, h = at_last(spark, sf), review.note_history(answers(spark, sf))
    parts = h.select("note_id", review.spaced_score(F.col("last_quizzed"), F.col("streak"), n).alias("spaced"), review.richness(F.col("note_id") % 9, F.col("note_id") % 1500).alias("rich"), review.recency(F.col("last_quizzed"), n).alias("recent"), review.variety(F.col("quiz_count")).alias("varied"), review.struggle(F.col("quiz_count"), F.col("correct_count")).alias("hard"))
    return parts.select("note_id", "spaced", "recent", "varied", "hard", F.round(review.total(*[F.col(c) for c in ("spaced", "rich", "recent", "varied", "hard")]), 6).alias("total"))


@query("WITH l AS (SELECT event_id, ts, event_type FROM events WHERE event_id % 3 <> 0), r AS (SELECT event_id, ts, 'remote' AS event_type FROM events WHERE event_id % 2 = 0) SELECT * FROM l UNION ALL SELECT * FROM r WHERE event_id NOT IN (SELECT event_id FROM l)")
def merge_events(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", "event_type")
    return review.merge_events(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("event_type", F.lit("remote")))


OLD, NEW = "SELECT label::BIGINT AS cluster, vec_id AS id FROM embeddings", "SELECT CASE WHEN vec_id % 4 = 0 THEN (label + 3) % 10 WHEN label < 3 THEN vec_id % 20 ELSE label + 10 END::BIGINT AS cluster, vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0"


def memberships(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "embeddings")
    old = e.select(F.col("label").cast("bigint").alias("cluster"), F.col("vec_id").alias("id"))
    new = e.where("vec_id % 7 <> 0").select(F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 3) % 10).when(F.col("label") < 3, F.col("vec_id") % 20).otherwise(F.col("label") + 10).cast("bigint").alias("cluster"), F.col("vec_id").alias("id"))
    return old, new


@query("SELECT x.goal_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM (SELECT o_orderkey AS goal_id, [o_orderkey % 3, o_orderkey % 5, 7] AS a, [o_orderkey % 4, o_orderkey % 5] AS b FROM orders) x")
def cluster_jaccard(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("goal_id"), F.round(clusters.jaccard(F.array(k % 3, k % 5, F.lit(7).cast("bigint")), F.array(k % 4, k % 5)), 9).alias("jaccard"))


@query(f"WITH o AS ({OLD}), n AS ({NEW}), b AS (SELECT o.cluster AS o, n.cluster AS n, count(*) AS k FROM o JOIN n USING (id) GROUP BY 1, 2), s AS (SELECT o, n, k / (so + sn - k)::DOUBLE AS j FROM b JOIN (SELECT cluster AS o, count(*) AS so FROM o GROUP BY 1) USING (o) JOIN (SELECT cluster AS n, count(*) AS sn FROM n GROUP BY 1) USING (n)), m AS (SELECT o, n, j FROM s QUALIFY row_number() OVER (PARTITION BY o ORDER BY j DESC, n) = 1) SELECT c.cluster AS old_cluster, CASE WHEN j > 0.2 THEN n ELSE -1 END AS new_cluster, round(coalesce(j, 0.0), 9) AS jaccard, CASE WHEN j > 0.6 THEN 'renamed' WHEN j > 0.2 THEN 'remapped' ELSE 'dissolved' END AS change FROM (SELECT DISTINCT cluster FROM o) c LEFT JOIN m ON m.o = c.cluster")
def cluster_evolution(spark, sf):
    return clusters.evolution(*memberships(spark, sf)).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, coalesce(o.cluster, -1) AS from_cluster, coalesce(n.cluster, -1) AS to_cluster FROM o FULL JOIN n ON o.id = n.id WHERE o.cluster IS DISTINCT FROM n.cluster")
def note_movements(spark, sf):
    m = clusters.movements(*memberships(spark, sf))
    return m.select("id", *[F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("from_cluster", "to_cluster")])


@query("SELECT goal_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(notes_paths, ['n8', 'n1'])), lambda x: x NOT IN ('n2', 'n3'))), ',') AS notes FROM (" + GOALS + ")")
def effective_notes(spark, sf):
    lit = lambda *x: F.array(*map(F.lit, x))
    return goals(spark, sf).select("goal_id", F.array_join(F.array_sort(clusters.effective(F.col("notes_paths"), lit("n8", "n1"), lit("n2", "n3"))), ",").alias("notes"))


def labelled(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), "embedding")


D_CENTER = "WITH x AS (SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT cluster, i, avg(x) AS x FROM x GROUP BY 1, 2)"


@query(f"{D_CENTER} SELECT cluster, i, round(x, 6) AS x FROM c")
def centroids(spark, sf):
    return clusters.centroids(labelled(spark, sf)).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"{D_CENTER}, l AS (SELECT cluster, list(x ORDER BY i) AS e FROM c GROUP BY 1) SELECT cluster, id, rank FROM (SELECT label AS cluster, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY list_dot_product(embedding::DOUBLE[], e) DESC, vec_id) AS rank FROM embeddings JOIN l ON l.cluster = label) WHERE rank <= 5")
def representatives(spark, sf):
    v = labelled(spark, sf)
    return clusters.representatives(v, clusters.centroids(v)).select("cluster", "id", "rank")


@query("WITH q AS (SELECT l_orderkey // 4 AS quiz_id, l_orderkey * 10 + l_linenumber AS question_id, ['multiple-choice', 'true-false', 'fill-blank', 'open-ended'][l_suppkey % 4 + 1] AS format, l_quantity AS quality FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY quiz_id, format ORDER BY quality DESC, question_id) > (CASE format WHEN 'multiple-choice' THEN 4 ELSE 2 END) AS backfill FROM q), p AS (SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY backfill, quality DESC, question_id) AS place FROM r) SELECT quiz_id, question_id, backfill, place FROM p WHERE place <= 10")
def question_mix(spark, sf):
    l = read(spark, sf, "lineitem")  # noqa: E741
    formats = F.array(*map(F.lit, review.MIX))
    q = l.select(F.floor(F.col("l_orderkey") / 4).alias("quiz_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), F.element_at(formats, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("format"), F.col("l_quantity").alias("quality"))
    return review.question_mix(q).select("quiz_id", "question_id", "backfill", "place")


@query("SELECT DISTINCT user_id AS note_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphans(spark, sf):
    notes = read(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("note_id"))
    return review.orphans(answers(spark, sf), notes).select("note_id").distinct()


@query("WITH d AS (SELECT ts::DATE AS day, sum(event_id % 100)::BIGINT AS tokens FROM events GROUP BY 1) SELECT day::VARCHAR AS day, tokens, sum(tokens) OVER (ORDER BY day)::BIGINT AS cumulative, tokens <= 5000 AS within_budget FROM d")
def token_usage_daily(spark, sf):
    e = read(spark, sf, "events").select("ts", (F.col("event_id") % 100).alias("tokens"))
    return review.usage_by_day(e, 5000).withColumn("day", F.col("day").cast("string"))


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE contains(lower(concat('Doc ', seq)), 'doc 12') OR list_contains({D_TAGS}, '#doc 12')")
def note_search(spark, sf):
    n = notes_of(spark, sf).select("path", F.concat(F.lit("Doc "), "seq").alias("title"), markdown.tags(F.col("content")).alias("tags"))
    return review.search_notes(n, "Doc 12").select("path")


@query("SELECT o_orderkey AS goal_id, date_diff('day', DATE '1998-01-01', o_orderdate::DATE) AS days_left FROM orders")
def days_left(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"), review.days_left(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")).alias("days_left"))
