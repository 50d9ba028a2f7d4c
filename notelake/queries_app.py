"""More of the query catalogue: what the application keeps and does (goals, conversations, quizzes, cache, key-value store, documents, streams, clusters), each with its SQL.

Tables of the driver stand for the application's: orders are goals, line items their milestones or questions, conversations are conversations, documents are notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import globs, ids, markdown
from .functions import json as model_json
from .operators import cache, clusters, density, documents, layout, noteindex, numbering, review, rollups, state
from .plans import prompts, providers, relevance
from .queries import D_EMBEDDED, D_SIM, D_TAGS, LETTERS, NOW, QUERIES, SQL, WITH_NOTES, d_trim, goals, labelled, memberships, notes_of, now, query, quiz, read, talk
from .session import dealt, shared_dir
from .sources import notes as sources
from .streaming import events, limits, saving

__all__ = ["QUERIES", "SQL"]


def fresh(spark, label: str) -> str:
    """A new place in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def d_uuid(prefix: str, *keys: str) -> str:
    """The SQL of ``ids.entity_id``."""
    made = "concat('{', " + ", ',', ".join(f"'\"k{i}\":\"', ({k})::VARCHAR, '\"'" for i, k in enumerate(keys)) + ", '}')"
    return f"(SELECT concat('{prefix}-', left(h, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) FROM (SELECT md5({made}) AS h))"


# --- paths, keys, names ---


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE NOT regexp_full_match(path, 'templates/.*|\\.hidden/.*')")
def exclude_parsed(spark, sf):
    return globs.exclude(notes_of(spark, sf), globs.parse_patterns("templates/**\n# a comment\n\n   .hidden/**  ")).select("path")


@query(r"SELECT doc_id, regexp_full_match(p, 'goals/[^/]+/goal\.md') AS is_goal, starts_with(p, 'goals/g1/') AND ends_with(p, '.md') AS in_folder FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('goals/', source, '/goal.md') WHEN 1 THEN 'goals/g1/conv.md' WHEN 2 THEN 'goals/goal.md' WHEN 3 THEN 'goals/g1/goal.mdx' ELSE 'x/goals/g/goal.md' END AS p FROM documents)")
def document_paths(spark, sf):
    k = F.col("doc_id") % 5
    p = F.when(k == 0, F.concat(F.lit("goals/"), "source", F.lit("/goal.md"))).when(k == 1, "goals/g1/conv.md").when(k == 2, "goals/goal.md").when(k == 3, "goals/g1/goal.mdx").otherwise("x/goals/g/goal.md")
    return read(spark, sf, "documents").select("doc_id", globs.is_goal_document(p).alias("is_goal"), globs.in_folder(p, "goals/g1").alias("in_folder"))


ODD_ID = "CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat('a/', doc_id) WHEN 2 THEN concat('a', chr(92), 'b') WHEN 3 THEN concat('..', doc_id) WHEN 4 THEN NULL ELSE concat('goal-', doc_id) END"


@query(f"SELECT doc_id, coalesce({d_trim('x')} <> '' AND NOT contains(x, '/') AND NOT contains(x, chr(92)) AND NOT contains(x, '..'), false) AS ok FROM (SELECT doc_id, {ODD_ID} AS x FROM documents)")
def goal_id_validation(spark, sf):
    return spark.sql(f"SELECT doc_id, {ODD_ID.replace('chr(92)', 'char(92)')} AS x FROM {{d}}", d=read(spark, sf, "documents")).select("doc_id", rollups.goal_id_ok(F.col("x")).alias("ok"))


ODD_KEY = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'sk-ant-1' WHEN 2 THEN concat(' sk-ant-', md5(doc_id::VARCHAR), ' ') WHEN 3 THEN concat('sk-ant-abc def ', md5(doc_id::VARCHAR)) WHEN 4 THEN 'pa-123' ELSE concat('pa-', md5(doc_id::VARCHAR)) END"


@query(f"SELECT doc_id, CASE WHEN k = '' THEN 'missing' WHEN NOT starts_with(k, 'sk-ant-') THEN 'prefix' WHEN length(k) < 20 THEN 'short' WHEN contains(k, ' ') THEN 'space' ELSE 'ok' END AS first, CASE WHEN k = '' THEN 'missing' WHEN length(k) < 10 THEN 'short' WHEN contains(k, ' ') THEN 'space' ELSE 'ok' END AS second FROM (SELECT doc_id, trim(coalesce({ODD_KEY}, '')) AS k FROM documents)")
def api_key_check(spark, sf):
    rows = spark.sql(f"SELECT doc_id, {ODD_KEY.replace('doc_id::VARCHAR', 'cast(doc_id as string)')} AS k FROM {{d}}", d=read(spark, sf, "documents"))
    return rows.select("doc_id", *[F.coalesce(ids.key_error(p, F.col("k")), F.lit("ok")).alias(n) for n, p in (("first", "anthropic"), ("second", "voyage"))])


@query(r"SELECT doc_id, left(trim(replace(regexp_replace(concat(' a/b', chr(92), doc_id, ':*?<>|..', text), '[/\\:*?" + '"' + r"<>|]', '', 'g'), '..', '')), 100) AS name FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS text FROM documents)")
def sanitized_goal_names(spark, sf):
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    name = F.concat(F.lit(" a/b\\"), F.col("doc_id").cast("string"), F.lit(":*?<>|.."), flat)
    return read(spark, sf, "documents").select("doc_id", rollups.sanitized_goal_name(name).alias("name"))


@query("SELECT o_orderkey AS goal_id, strftime(o_orderdate::DATE, '%b %-d, %Y') AS deadline FROM orders")
def date_texts(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"), ids.date_text(F.col("o_orderdate").cast("date")).alias("deadline"))


@query(f"SELECT o_orderkey AS goal_id, {d_uuid('goal', 'o_orderkey')} AS id, concat('msg-', epoch_ms(o_orderdate::TIMESTAMP), '-', o_orderkey % 10) AS message_id FROM orders")
def entity_ids(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("goal_id"), ids.entity_id("goal", k).alias("id"), ids.timed_id("msg", F.col("o_orderdate").cast("timestamp"), k % 10).alias("message_id"))


# --- notes as a table ---


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE seq % 3 = 0")
def existing_notes(spark, sf):
    n = notes_of(spark, sf)
    wanted = n.where("seq % 3 = 0").select("path").unionAll(n.select(F.concat(F.lit("no/"), "path").alias("path")))
    return sources.existing(wanted, n)


@query(f"{WITH_NOTES} SELECT path, length(content) AS n FROM notes WHERE seq % 4 = 1")
def readable_notes(spark, sf):
    n = notes_of(spark, sf)
    return sources.readable(n.where("seq % 4 = 1").select("path"), n).select("path", F.length("content").cast("bigint").alias("n"))


@query(f"{WITH_NOTES} SELECT path, CASE WHEN seq % 5 = 0 THEN 'edited' ELSE md5(content) END AS digest FROM notes WHERE seq % 7 <> 0 AND NOT starts_with(path, 'templates/') UNION ALL SELECT concat('new/', seq, '.md'), 'new' FROM notes WHERE seq % 10 = 0")
def note_changes(spark, sf):
    """Notes created, modified and deleted, and a folder deleted."""
    n = notes_of(spark, sf).select("seq", "path", F.md5(F.col("content").cast("binary")).alias("content"))
    made = sources.create(n.select("path", "content"), n.where("seq % 10 = 0").select(F.concat(F.lit("new/"), "seq", F.lit(".md")).alias("path"), F.lit("new").alias("content")).unionAll(n.where("seq % 9 = 0").select("path", F.lit("ignored"))))
    changed = sources.modify(made, n.where("seq % 5 = 0").select("path", F.lit("edited").alias("content")))
    return sources.delete_folder(sources.delete(changed, n.where("seq % 7 = 0")), "templates").select("path", F.col("content").alias("digest"))


@query("SELECT concat('key/', c_custkey) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN concat('{\"n\":', c_custkey + 1, '}') ELSE concat('{\"n\":', c_custkey, '}') END AS value FROM customer WHERE c_custkey % 7 <> 0")
def key_value_entries(spark, sf):
    """Values written, overwritten, broken and removed."""
    c, key = read(spark, sf, "customer"), F.concat(F.lit("key/"), "c_custkey").alias("key")
    store = sources.KeyValueStore(spark, fresh(spark, "values"), 8)
    value = lambda x: F.concat(F.lit('{"n":'), x, F.lit("}")).alias("value")
    store.put(c.select(key, F.when(F.col("c_custkey") % 5 == 0, "{broken").otherwise(value(F.col("c_custkey"))).alias("value")))
    store.put(c.where("c_custkey % 3 = 0 and c_custkey % 5 <> 0").select(key, value(F.col("c_custkey") + 1)))
    store.remove(c.where("c_custkey % 7 = 0").select(key))
    return store.entries()


@query(f"{WITH_NOTES}, e AS (SELECT path, seq, CASE WHEN seq % 4 = 0 THEN 'second' ELSE 'first' END AS content_hash FROM notes WHERE seq % 6 <> 0) SELECT path, content_hash, seq AS token_count FROM e")
def cache_entries(spark, sf):
    """Entries set, replaced by newer ones and invalidated; another model's stay out of sight."""
    n = notes_of(spark, sf).select("path", "seq")
    place = fresh(spark, "cache")
    mine, other = cache.EmbeddingCache(spark, place, "voyage", "a", 8), cache.EmbeddingCache(spark, place, "voyage", "b", 8)
    rows = lambda df, h, at: df.select("path", F.lit(h).alias("content_hash"), F.array(F.col("seq").cast("float")).alias("embedding"), F.col("seq").cast("int").alias("token_count"), F.lit(at).cast("timestamp").alias("created_at"))
    mine.set(rows(n, "first", "2030-01-01"))
    other.set(rows(n, "other", "2031-01-01"))
    mine.set(rows(n.where("seq % 4 = 0"), "second", "2030-01-02").unionAll(rows(n.where("seq % 4 = 1"), "older", "2029-01-01")))
    mine.invalidate(n.where("seq % 6 = 0").select("path"))
    return mine.get().select("path", "content_hash", F.col("token_count").cast("bigint").alias("token_count"))


@query(f"{WITH_NOTES} SELECT count(*) AS entries, sum(seq)::BIGINT AS tokens, count(*) FILTER (WHERE seq % 2 = 0) AS known FROM notes WHERE seq % 2 = 0")
def cache_stats(spark, sf):
    n = notes_of(spark, sf).select("path", "seq")
    held = cache.EmbeddingCache(spark, fresh(spark, "cache"), "voyage", "a", 8)
    held.set(n.where("seq % 2 = 0").select("path", F.lit("h").alias("content_hash"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.col("seq").cast("int").alias("token_count"), F.lit(NOW).cast("timestamp").alias("created_at")))
    return held.stats().select("entries", "tokens", F.lit(held.has(n.select("path")).count()).cast("bigint").alias("known"))


# --- documents ---

GOAL_ROWS = "SELECT o_orderkey AS goal_id, concat('Goal \"', o_orderkey, '\": [x]') AS name, concat('line', chr(10), 'two') AS description, o_orderdate::DATE::VARCHAR AS deadline, CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'completed' END AS status FROM orders"


def goal_documents(spark, sf) -> DataFrame:
    """Goals as documents; every seventh one is broken."""
    g = spark.sql("SELECT o_orderkey AS goal_id, concat('Goal \"', o_orderkey, '\": [x]') AS name, concat('line', char(10), 'two') AS description, cast(cast(o_orderdate as date) as string) AS deadline, CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'completed' END AS status FROM {o}", o=read(spark, sf, "orders"))
    stones = F.array(*[F.struct(F.lit(f"m{i}").alias("id"), F.lit(f"Step {i}: go").alias("content"), (F.col("goal_id") % 3 == i).alias("completed"), F.lit(i).alias("order")) for i in range(2)])
    fields = F.struct(F.concat(F.lit("goal-"), "goal_id").alias("id"), "name", "description", "deadline", "status", F.array(F.lit("a b.md"), F.concat(F.lit("x/"), "goal_id", F.lit(".md"))).alias("notesPaths"), stones.alias("milestones"))
    saved = g.select("goal_id", documents.save(fields, F.concat(F.lit("Body "), "goal_id")).alias("content"))
    return saved.withColumn("content", F.when(F.col("goal_id") % 7 == 0, F.replace("content", F.lit("---\n"), F.lit("***\n"))).otherwise(F.col("content")))


@query(f"SELECT goal_id, name, description, deadline, status, concat('a b.md|x/', goal_id, '.md') AS notes, concat('m0:', goal_id % 3 = 0, '|m1:', goal_id % 3 = 1) AS stones, concat('Body ', goal_id) AS body FROM ({GOAL_ROWS}) WHERE goal_id % 7 <> 0")
def goal_documents_read(spark, sf):
    d = documents.accepted(documents.load(goal_documents(spark, sf), documents.GOAL))
    stones = F.array_join(F.transform("fields.milestones", lambda m: F.concat(m["id"], F.lit(":"), m["completed"].cast("string"))), "|")
    return d.select("goal_id", "fields.name", "fields.description", "fields.deadline", "fields.status", F.array_join("fields.notesPaths", "|").alias("notes"), stones.alias("stones"), "body")


@query("SELECT o_orderkey AS goal_id FROM orders WHERE o_orderkey % 7 = 0")
def goal_documents_rejected(spark, sf):
    return documents.rejects(documents.load(goal_documents(spark, sf), documents.GOAL)).select("goal_id")


def spoken(spark, sf) -> DataFrame:
    """Messages with times and sources; texts on one line."""
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    some = F.when((F.col("role") == "assistant") & (F.col("seq") % 4 == 1), F.array(F.lit("a.md"), F.concat(F.lit("b "), "seq", F.lit(".md"))))
    return talk(spark, sf).select("conversation_id", "seq", "role", F.concat(F.lit("2030-01-01T00:00:"), F.lpad(F.col("seq").cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"), flat.alias("content"), some.alias("sources"))


D_SPOKEN = "SELECT conv_id AS conversation_id, turn AS seq, role, concat('2030-01-01T00:00:', lpad(turn::VARCHAR, 2, '0'), 'Z') AS timestamp, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN concat('a.md|b ', turn, '.md') END AS sources FROM conversations"


@query(f"SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) - 1 AS place, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, timestamp, content, coalesce(sources, '-') AS sources FROM ({D_SPOKEN}) WHERE content <> ''")
def conversation_documents(spark, sf):
    """Conversations written as documents and parsed back."""
    body = documents.write_messages(spoken(spark, sf))
    fields = F.struct(F.concat(F.lit("conv-"), "conversation_id").alias("id"), F.lit("T: x").alias("topic"))
    loaded = documents.accepted(documents.load(body.select("conversation_id", documents.save(fields, F.col("body")).alias("content")), documents.CONVERSATION))
    rows = loaded.select("conversation_id", F.posexplode(documents.messages(F.col("body"))).alias("place", "m"))
    return rows.select("conversation_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.timestamp", "m.content", F.coalesce(F.array_join("m.sources", "|"), F.lit("-")).alias("sources"))


@query(f"SELECT conversation_id, concat('conv-', conversation_id) AS id, CASE WHEN conversation_id % 2 = 0 THEN 'Kept' ELSE 'Recovered Discussion' END AS topic, count(*) FILTER (WHERE content <> '') AS messages FROM ({D_SPOKEN}) GROUP BY 1")
def recovered_conversations(spark, sf):
    """Conversation documents with broken front matter, salvaged."""
    body = documents.write_messages(spoken(spark, sf))
    topic_ = F.when(F.col("conversation_id") % 2 == 0, 'topic: "Kept"\n').otherwise("")
    broken = F.concat(F.lit("---\n: : id none\n"), topic_, F.lit("  ]bad\n---\n"), F.col("body"))
    r = documents.recover(F.col("content"), F.concat(F.lit("conv-"), "conversation_id"))
    return body.select("conversation_id", broken.alias("content")).select("conversation_id", r.alias("r")).select("conversation_id", F.when(F.col("r.id").startswith("conv"), F.col("r.id")).otherwise(F.concat(F.lit("conv-"), "conversation_id")).alias("id"), "r.topic", F.size("r.messages").cast("bigint").alias("messages"))


# --- goals ---

DRAFTS = "SELECT o_orderkey AS draft_id, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE concat('Learn ', o_orderkey) END AS name, 'd' AS description, '2030-01-01' AS deadline, CASE WHEN o_orderkey % 7 = 0 THEN []::VARCHAR[] ELSE ['one', concat('two ', o_orderkey)] END AS milestones FROM orders"


def drafts(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    return read(spark, sf, "orders").select(k.alias("draft_id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("Learn "), k)).alias("name"), F.lit("d").alias("description"), F.lit("2030-01-01").alias("deadline"), F.when(k % 7 == 0, none).otherwise(F.array(F.lit("one"), F.concat(F.lit("two "), k))).alias("milestones"), F.lit(None).cast("array<string>").alias("notes_paths"))


@query(f"SELECT {d_uuid('goal', 'draft_id')} AS goal_id, name, 'active' AS status, '{NOW}' AS created_at, 0 AS notes FROM ({DRAFTS}) WHERE draft_id % 5 <> 0 AND draft_id % 7 <> 0")
def goals_created(spark, sf):
    made, _, _ = state.create_goals(drafts(spark, sf), now())
    return made.select("goal_id", "name", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.size("notes_paths").cast("bigint").alias("notes"))


@query(f"WITH g AS (SELECT {d_uuid('goal', 'draft_id')} AS goal_id, milestones FROM ({DRAFTS}) WHERE draft_id % 5 <> 0 AND draft_id % 7 <> 0), m AS (SELECT goal_id, unnest(milestones) AS content, generate_subscripts(milestones, 1) - 1 AS ord FROM g) SELECT goal_id, {d_uuid('milestone', 'goal_id', 'ord')} AS milestone_id, content, ord AS place, false AS completed FROM m")
def milestones_created(spark, sf):
    _, made, _ = state.create_goals(drafts(spark, sf), now())
    return made.select("goal_id", "milestone_id", "content", F.col("order").cast("bigint").alias("place"), "completed")


@query(f"SELECT draft_id, concat_ws(',', CASE WHEN draft_id % 5 = 0 THEN 'name' END, CASE WHEN draft_id % 7 = 0 THEN 'milestones' END) AS errors FROM ({DRAFTS}) WHERE draft_id % 5 = 0 OR draft_id % 7 = 0")
def goals_refused(spark, sf):
    _, _, refused = state.create_goals(drafts(spark, sf), now())
    return refused.select("draft_id", F.array_join("errors", ",").alias("errors"))


def goal_table(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("goal_id"), F.concat(F.lit("Goal "), k).alias("name"), F.lit("d").alias("description"), F.lit("active").alias("status"), F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"))


@query("SELECT o_orderkey AS goal_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'renamed' ELSE concat('Goal ', o_orderkey) END AS name, 'd' AS description, 'old' AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'now' ELSE 'old' END AS updated_at FROM orders")
def goal_update(spark, sf):
    """Partial updates: null fields keep what was there, the creation time never changes."""
    g = goal_table(spark, sf)
    new = g.where("goal_id % 3 = 0").select("goal_id", F.when(F.col("goal_id") % 2 == 0, "renamed").alias("name"), F.lit("later").alias("created_at"))
    return documents.upsert(g, new, "goal_id", ("created_at",), F.lit("now")).drop("status")


@query("SELECT o_orderkey AS goal_id, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' ELSE 'active' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'now' ELSE 'old' END AS updated_at FROM orders")
def goal_complete(spark, sf):
    g = goal_table(spark, sf)
    return state.complete_goals(g, g.where("goal_id % 4 = 0"), F.lit("now")).select("goal_id", "status", "updated_at")


def stones(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("goal_id"), F.concat(F.lit("m"), "l_linenumber").alias("milestone_id"), F.concat(F.lit("step "), "l_linenumber").alias("content"), F.col("l_linenumber").cast("int").alias("order"), (F.col("l_linestatus") == "F").alias("completed"))


@query("SELECT l_orderkey AS goal_id, string_agg(concat('m', l_linenumber), ',' ORDER BY l_linenumber) AS milestones FROM lineitem GROUP BY 1")
def milestones_in_order(spark, sf):
    return state.milestone_list(stones(spark, sf)).select("goal_id", F.array_join(F.transform("milestones", lambda m: m["milestone_id"]), ",").alias("milestones"))


@query("SELECT l_orderkey AS goal_id, string_agg(CASE WHEN done <> (l_linenumber = 2) THEN 'x' ELSE '-' END, '' ORDER BY l_linenumber) AS marks FROM (SELECT l_orderkey, l_linenumber, bool_or(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def milestone_toggle(spark, sf):
    one = stones(spark, sf).groupBy("goal_id", "order", "milestone_id").agg(F.max("completed").alias("completed"))
    held = one.groupBy("goal_id").agg(F.array_sort(F.collect_list(F.struct("order", F.col("milestone_id").alias("id"), "completed"))).alias("m"))
    return held.select("goal_id", F.array_join(F.transform(rollups.toggle(F.col("m"), "m2"), lambda m: F.when(m["completed"], "x").otherwise("-")), "").alias("marks"))


@query(f"SELECT l_orderkey AS goal_id, concat('m', l_linenumber) AS milestone_id, concat('step ', l_linenumber) AS content FROM lineitem WHERE l_orderkey % 6 <> 0 UNION ALL SELECT o_orderkey, {d_uuid('milestone', 'o_orderkey', '0')}, 'only' FROM orders WHERE o_orderkey % 6 = 0")
def milestones_set(spark, sf):
    new = read(spark, sf, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("goal_id"), F.array(F.lit("only")).alias("milestones"))
    return state.set_milestones(stones(spark, sf), new).select("goal_id", "milestone_id", "content")


@query("SELECT l_orderkey AS goal_id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 5 <> 0")
def goal_delete(spark, sf):
    """A goal goes with all that belongs to it."""
    gone = goal_table(spark, sf).where("goal_id % 5 = 0")
    left = documents.delete_cascade({"goals": goal_table(spark, sf), "milestones": stones(spark, sf)}, gone)
    return left["milestones"].groupBy("goal_id").agg(F.count("*").alias("n")).unionAll(left["goals"].select("goal_id", F.lit(-1).cast("bigint")))


@query("SELECT goal_id, i - 1 AS place, 'n' || p AS path FROM (SELECT o_orderkey AS goal_id, unnest([o_orderkey % 7, o_orderkey % 5, o_orderkey % 7]) AS p, generate_subscripts([1, 2, 3], 1) AS i FROM orders) WHERE p % 2 = 0")
def goal_notes_readable(spark, sf):
    there = spark.range(0, 10, 2).select(F.concat(F.lit("n"), "id").alias("path"), F.lit("text").alias("content"))
    return state.readable_notes(goals(spark, sf), there).select("goal_id", F.col("place").cast("bigint").alias("place"), "path")


@query("SELECT o.o_orderkey AS goal_id, 3 AS notes, coalesce(m, 0) AS messages, coalesce(q, 0) AS questions FROM orders o LEFT JOIN (SELECT conv_id AS k, count(*) AS m FROM conversations GROUP BY 1) USING (k) LEFT JOIN (SELECT l_orderkey AS k, count(*) AS q FROM lineitem GROUP BY 1) USING (k)".replace("orders o LEFT", "(SELECT *, o_orderkey AS k FROM orders) o LEFT"))
def goal_counts(spark, sf):
    messages = talk(spark, sf).select(F.col("conversation_id").alias("goal_id"))
    return state.goal_counts(goals(spark, sf), messages, stones(spark, sf))


@query("SELECT o_orderkey AS goal_id, CASE WHEN list_contains(s, 'n1') THEN array_to_string(list_filter(s, lambda x: x <> 'n1'), ',') ELSE array_to_string(list_concat(s, ['n1']), ',') END AS chosen FROM (SELECT o_orderkey, [concat('n', o_orderkey % 3), 'n7'] AS s FROM orders)")
def selection_toggle(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("goal_id"), F.array_join(state.toggled(F.array(F.concat(F.lit("n"), k % 3), F.lit("n7")), F.lit("n1")), ",").alias("chosen"))


@query("SELECT o_orderkey AS goal_id FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def goals_newest_first(spark, sf):
    return state.newest_first(read(spark, sf, "orders"), "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("goal_id"))


# --- conversations ---

D_NEW = "conversation_id % 3 = 0"


def conversation_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = spoken(spark, sf).withColumn("sources", F.lit(None).cast("array<string>"))
    return m.select("conversation_id").distinct().select("conversation_id", (F.col("conversation_id") % 50).alias("goal_id"), F.lit("New Discussion").alias("topic"), F.lit("t").alias("created_at")), m


def exchanges(spark, sf) -> DataFrame:
    c, _ = conversation_tables(spark, sf)
    return c.where(D_NEW).select("conversation_id", F.lit("why?").alias("question"), F.lit("because").alias("content"), F.array(F.lit("a.md")).alias("sources"), F.lit("later").alias("timestamp"))


@query(f"SELECT conversation_id, seq, role, content FROM ({D_SPOKEN}) UNION ALL SELECT conversation_id, max(seq) + 1, 'user', 'why?' FROM ({D_SPOKEN}) WHERE {D_NEW} GROUP BY 1 UNION ALL SELECT conversation_id, max(seq) + 2, 'assistant', 'because' FROM ({D_SPOKEN}) WHERE {D_NEW} GROUP BY 1")
def exchanges_saved(spark, sf):
    _, m = state.save_exchanges(*conversation_tables(spark, sf), exchanges(spark, sf))
    return m.select("conversation_id", "seq", "role", "content")


D_FIRST = f"SELECT conversation_id, arg_min(content, seq) FILTER (WHERE role = 'user') AS f FROM ({D_SPOKEN}) GROUP BY 1"


@query(f"SELECT conversation_id, CASE WHEN f IS NULL THEN CASE WHEN {D_NEW} THEN 'why?' ELSE 'New Discussion' END WHEN length(f) <= 50 THEN f WHEN length(left(f, 51)) - instr(reverse(left(f, 51)), ' ') > 20 AND contains(left(f, 51), ' ') THEN concat(left(f, (length(left(f, 51)) - instr(reverse(left(f, 51)), ' '))::INT), '...') ELSE concat(left(f, 50), '...') END AS topic FROM ({D_FIRST})")
def conversations_retopiced(spark, sf):
    c, _ = state.save_exchanges(*conversation_tables(spark, sf), exchanges(spark, sf))
    return c.select("conversation_id", "topic")


@query(f"SELECT conversation_id, count(*) FILTER (WHERE conversation_id % 5 <> 1) AS messages FROM ({D_SPOKEN}) WHERE conversation_id % 4 <> 0 GROUP BY 1")
def conversations_deleted_and_reset(spark, sf):
    c, m = conversation_tables(spark, sf)
    c, m = state.delete_conversations(c, m, c.where("conversation_id % 4 = 0"))
    c, m = state.reset_conversations(c, m, c.where("conversation_id % 5 = 1"))
    return c.join(m.groupBy("conversation_id").agg(F.count("*").alias("messages")), "conversation_id", "left").select("conversation_id", F.coalesce("messages", F.lit(0)).alias("messages"))


@query(f"SELECT {d_uuid('conv', 'o_custkey', 'o_orderkey')} AS conversation_id, o_custkey AS goal_id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'New Discussion' END AS topic FROM orders")
def conversations_created(spark, sf):
    new = read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("goal_id"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("topic"))
    return state.create_conversations(new, now()).select("conversation_id", "goal_id", "topic")


# --- quizzes ---


def sessions(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit(1).alias("goal_id"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("bigint").alias("score"))


def one_quiz(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Questions and answers, one for each key: line numbers come again within some orders."""
    q, a = quiz(spark, sf)
    key = "session_id", "question_id"
    return dealt(q, *key).distinct(), dealt(a, *key).groupBy("session_id", "question_id").agg(F.max("is_correct").alias("is_correct"))


D_ONE = "SELECT l_orderkey AS s, l_linenumber AS q, bool_or(l_partkey % 4 <> 0) AS had, coalesce(bool_or(l_returnflag = 'N') FILTER (WHERE l_partkey % 4 <> 0), false) AS correct FROM lineitem GROUP BY 1, 2"
D_SUBMIT = f"WITH a AS (SELECT s, q, CASE WHEN had THEN correct ELSE true END AS c, had OR s % 2 = 0 AS answered FROM ({D_ONE}))"


def submitted(spark, sf) -> DataFrame:
    """Answers to the questions that have none, in every second session, and repeats that change nothing."""
    q, _ = quiz(spark, sf)
    return q.where("session_id % 2 = 0").select("session_id", "question_id", F.lit(True).alias("is_correct")).unionAll(q.where("session_id % 2 = 0").select("session_id", F.lit(99).cast(q.schema["question_id"].dataType), F.lit(True)))


@query(f"{D_SUBMIT} SELECT s AS session_id, q AS question_id, c AS is_correct FROM a WHERE answered")
def answers_submitted(spark, sf):
    q, a = one_quiz(spark, sf)
    return state.submit_answers(sessions(spark, sf), q, a, submitted(spark, sf), now())[1]


@query(f"{D_SUBMIT}, d AS (SELECT s, floor(100.0 * count(*) FILTER (WHERE c) / count(*) + 0.5)::BIGINT AS score FROM a GROUP BY 1 HAVING bool_and(answered)) SELECT o_orderkey AS session_id, coalesce(score, -1) AS score, score IS NOT NULL AS completed FROM orders LEFT JOIN d ON s = o_orderkey")
def sessions_scored(spark, sf):
    q, a = one_quiz(spark, sf)[0], quiz(spark, sf)[1]
    return state.submit_answers(sessions(spark, sf), q, a, submitted(spark, sf), now())[0].select("session_id", F.coalesce("score", F.lit(-1).cast("bigint")).alias("score"), F.col("completed_at").isNotNull().alias("completed"))


@query(f"SELECT {d_uuid('qa', 'o_custkey', 'o_orderkey')} AS session_id, {d_uuid('q', d_uuid('qa', 'o_custkey', 'o_orderkey'), 'l_linenumber - 1')} AS question_id, l_linenumber - 1 AS ordinal, concat('Q', l_linenumber) AS text FROM orders JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS l_linenumber FROM lineitem) ON l_orderkey = o_orderkey")
def sessions_created(spark, sf):
    new = read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("goal_id"))
    asked = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"))
    _, made = state.create_sessions(new, asked, now())
    return made.select("session_id", "question_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.concat(F.lit("Q"), F.col("ordinal") + 1).alias("text"))


D_STATUS = f"WITH x AS (SELECT s AS session_id, q AS question_id, had AS is_answered, correct AS is_correct FROM ({D_ONE}))"


@query(f"{D_STATUS} SELECT *, coalesce(question_id = min(CASE WHEN NOT is_answered THEN question_id END) OVER (PARTITION BY session_id), false) AS is_current FROM x")
def qa_status(spark, sf):
    return state.question_status(*one_quiz(spark, sf)).drop("ordinal")


@query("SELECT l_orderkey AS session_id, l_linenumber AS question_id, coalesce(lag(l_linenumber) OVER w, -1) AS previous_id, coalesce(lead(l_linenumber) OVER w, -1) AS next_id FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def qa_neighbours(spark, sf):
    n = state.neighbours(quiz(spark, sf)[0])
    return n.select("session_id", "question_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous_id", "next_id")])


@query(f"SELECT s AS session_id, row_number() OVER (PARTITION BY s ORDER BY q) - 1 AS ordinal, CASE WHEN q % 2 = 0 THEN 'multiple-choice' ELSE 'open-ended' END AS type, concat('What is ', q) AS text, CASE WHEN q % 2 = 0 THEN concat(s, ' a|', q, ' b|c: d|- e') ELSE '' END AS options, CASE WHEN q % 2 = 0 THEN s % 4 ELSE -1 END AS correct_answer, CASE WHEN had THEN 'it' END AS user_answer, CASE WHEN had THEN correct END AS is_correct, CASE WHEN had THEN 'fine' END AS explanation FROM ({D_ONE})")
def qa_document_round_trip(spark, sf):
    """Sessions of open and multiple-choice questions written as documents and parsed back."""
    q, a = one_quiz(spark, sf)
    choice, options = F.col("question_id") % 2 == 0, F.array(F.concat("session_id", F.lit(" a")), F.concat("question_id", F.lit(" b")), F.lit("c: d"), F.lit("- e"))
    rows = q.join(a, ["session_id", "question_id"], "left").select(
        "session_id", (F.col("ordinal") - 1).alias("ordinal"), F.when(choice, "multiple-choice").otherwise("open-ended").alias("type"), F.concat(F.lit("What is "), "question_id").alias("text"), F.lit("n.md").alias("source_note_path"),
        F.when(choice, options).otherwise(F.array().cast("array<string>")).alias("options"), F.when(choice, (F.col("session_id") % 4).cast("int")).alias("correct_answer"), F.when(F.col("is_correct").isNotNull(), "it").alias("user_answer"), "is_correct", F.when(F.col("is_correct").isNotNull(), "fine").alias("explanation"),
    )
    body = documents.write_questions(rows)
    fields = F.struct(F.concat(F.lit("qa-"), "session_id").alias("id"), F.lit("g").alias("goalId"))
    loaded = documents.accepted(documents.load(body.select("session_id", documents.save(fields, F.col("body")).alias("content")), documents.SESSION))
    return loaded.select("session_id", F.explode(documents.questions(F.col("body"))).alias("q")).select("session_id", F.col("q.ordinal").cast("bigint").alias("ordinal"), "q.type", "q.text", F.array_join("q.options", "|").alias("options"), F.coalesce("q.correct_answer", F.lit(-1)).cast("bigint").alias("correct_answer"), "q.user_answer", "q.is_correct", "q.explanation")


# --- prompts, requests, providers, streams ---


@query("SELECT o_orderkey AS goal_id, concat('Learning Goal: G', o_orderkey, chr(10), 'Description: D', chr(10), 'Milestones: a, b') AS text, concat('Learning Goal: G', o_orderkey, chr(10), 'Description: D') AS bare FROM orders")
def query_texts(spark, sf):
    k = F.concat(F.lit("G"), "o_orderkey")
    none = F.array().cast("array<string>")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"), relevance.query_text(k, F.lit("D"), F.array(F.lit("a"), F.lit("b"))).alias("text"), relevance.query_text(k, F.lit("D"), none).alias("bare"))


@query("SELECT conv_id AS conversation_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn % 4 = 0), '-') AS system, count(*) FILTER (WHERE turn % 4 <> 0) AS n, md5(coalesce(string_agg(concat(role, text), '|' ORDER BY turn) FILTER (WHERE turn % 4 <> 0), '')) AS digest, CASE WHEN conv_id % 2 = 0 THEN 100 ELSE 4096 END AS max_tokens FROM conversations GROUP BY conv_id")
def request_bodies(spark, sf):
    m = talk(spark, sf).withColumn("role", F.when(F.col("seq") % 4 == 0, "system").otherwise(F.col("role"))).withColumn("max_tokens", F.when(F.col("conversation_id") % 2 == 0, 100))
    b = prompts.request_bodies(m)
    said = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], x["content"])), "|")
    return b.select("conversation_id", F.coalesce("system", F.lit("-")).alias("system"), F.size("messages").cast("bigint").alias("n"), F.md5(said.cast("binary")).alias("digest"), "max_tokens")


@query("SELECT doc_id, concat('Goal: g', chr(10), 'Questions: ', doc_id % 9, chr(10), chr(10), 'ctx') AS asked, concat('Question: q', chr(10), 'Note:', chr(10), source, chr(10), 'Answer: a') AS judged FROM documents")
def prompt_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", prompts.question_prompt(F.lit("g"), F.lit("ctx"), F.col("doc_id") % 9).alias("asked"), prompts.evaluation_prompt(F.lit("q"), F.col("source"), F.lit("a")).alias("judged"))


class Failing(Exception):
    def __init__(self, status: int):
        super().__init__("failed")
        self.status = status


def answered_or_failing(text_: str) -> str:
    """What a provider says to a request that names a status."""
    status = int(text_)
    if status != 200:
        raise Failing(status)
    return "fine"


@query("SELECT c_custkey, CASE s WHEN 200 THEN 'fine' ELSE '-' END AS response, CASE s WHEN 200 THEN '-' WHEN 401 THEN 'invalid API key' WHEN 403 THEN 'access denied' WHEN 404 THEN 'not found' WHEN 429 THEN 'rate limit exceeded' WHEN 503 THEN 'server error' ELSE 'request failed' END AS error FROM (SELECT c_custkey, [200, 401, 403, 404, 429, 503, 400][c_custkey % 7 + 1] AS s FROM customer)")
def chat_errors(spark, sf):
    """One call a row; those worth it are tried again, failures become messages."""
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 429, 503, 400))), (F.col("c_custkey") % 7 + 1).cast("int"))
    asked = read(spark, sf, "customer").select("c_custkey", F.lit("s").alias("system"), F.array(F.struct(F.lit("user").alias("role"), status.cast("string").alias("content"))).alias("messages"))
    told = providers.chat(asked, providers.ScriptedChat(answered_or_failing), "c_custkey", base=0.0)
    return told.select("c_custkey", F.coalesce("response", F.lit("-")).alias("response"), F.coalesce("error", F.lit("-")).alias("error"))


@query("SELECT conv_id AS stream_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS content, count(*) AS output_tokens, 0 AS errors FROM conversations GROUP BY 1")
def chunked_streams(spark, sf):
    """Whole turns as event streams cut into chunks of 37 characters anywhere, the last line without its break."""
    c = read(spark, sf, "conversations")
    delta = F.to_json(F.struct(F.lit("text_delta").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    line = F.concat(F.lit('event: x\n\ndata: {"type":"content_block_delta","delta":'), delta, F.lit("}\n"))
    whole = c.withColumn("_l", line).groupBy(F.col("conv_id").alias("stream_id")).agg(F.expr("listagg(_l, '') within group (order by turn)").alias("w"), F.count("*").alias("n"))
    whole = whole.select("stream_id", F.concat("w", F.lit('data: {"type":"message_delta","usage":{"output_tokens":'), "n", F.lit("}}")).alias("w"))
    chunks = whole.select("stream_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / 37))).alias("seq")).select("stream_id", "seq", F.substring("w", (F.col("seq") * 37 + 1).cast("int"), F.lit(37)).alias("chunk"))
    return events.fold(events.lines_of(chunks)).select("stream_id", "content", "output_tokens", "errors")


# --- the relevance search ---

DRAFT = relevance.Draft("Learn statistics", "Understand inference", ["read", "solve"])
D_DRAFT = "concat('Learning Goal: Learn statistics', chr(10), 'Description: Understand inference', chr(10), 'Milestones: read, solve')"


def d_vector(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


D_SEARCH = f"{D_EMBEDDED}, g AS (SELECT {d_vector(D_DRAFT)} AS v), gq AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g), sim AS (SELECT path, seq, content, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), v), 12) AS similarity FROM u, gq WHERE NOT regexp_full_match(path, 'templates/.*')), top AS (SELECT * FROM sim ORDER BY similarity DESC, path LIMIT 40)"


@query(f"{D_SEARCH} SELECT path, {D_SIM} AS score, CASE WHEN {D_SIM} >= 90 THEN 'excellent' WHEN {D_SIM} >= 70 THEN 'high' WHEN {D_SIM} >= 50 THEN 'medium' WHEN {D_SIM} >= 30 THEN 'low' ELSE 'minimal' END AS band FROM top")
def relevance_search(spark, sf):
    """Filters, preparation, cache, provider, top k; a second search finds all vectors in the cache."""
    held = cache.EmbeddingCache(spark, fresh(spark, "cache"), "offline", "letters", 8)
    for _ in range(2):
        found = relevance.score_notes(notes_of(spark, sf), held, providers.LetterEmbeddings(LETTERS), DRAFT, [], ["templates/**"], 40)
    return found.select("path", "score", "band")


def scored_by_place(text_: str) -> str:
    """A model that scores every second note it is shown."""
    import re

    paths = re.findall(r"^### (\S.*\.md)$", text_, re.MULTILINE)
    items = ",".join(f'{{"notePath":"{p}","score":{100 - k},"reason":"r{k}"}}' for k, p in enumerate(paths) if k % 2 == 0)
    return f"Scores:\n```json\n[{items}]\n```"


@query(f"{D_SEARCH}, placed AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, path) - 1 AS k FROM top) SELECT path, CASE WHEN k % 2 = 0 THEN (100 - k)::DOUBLE ELSE {D_SIM} END AS score, CASE WHEN k % 2 = 0 THEN concat('r', k) ELSE '{relevance.REASON}' END AS reason FROM placed")
def relevance_search_explained(spark, sf):
    """The same with a model that scores and explains."""
    nothing = spark.createDataFrame([], "path string, content_hash string, embedding array<float>")
    found = relevance.score_notes(notes_of(spark, sf), nothing, providers.LetterEmbeddings(LETTERS), DRAFT, [], ["templates/**"], 40, providers.ScriptedChat(scored_by_place))
    return found.select("path", "score", "reason")


# --- clusters and review ---

D_CENTERS = "WITH x AS (SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), l AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1)"
D_DISTANCE = "sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda p: pow(p[1] - p[2], 2))))"


@query(f"{D_CENTERS}, s AS (SELECT vec_id AS id, cluster, list_dot_product(embedding::DOUBLE[], c) AS d FROM embeddings, l) SELECT id, CASE WHEN max(d) >= 0.5 THEN arg_max(cluster, d) ELSE -1 END AS cluster, round(max(d), 9) AS similarity FROM s GROUP BY 1")
def nearest_centroids(spark, sf):
    v = labelled(spark, sf)
    return clusters.assign(v.select("id", "embedding"), clusters.centroids(v)).withColumn("similarity", F.round("similarity", 9))


@query(f"{D_CENTERS} SELECT label AS cluster, count(*) AS size, round(avg({D_DISTANCE}), 8) AS compactness FROM embeddings JOIN l ON l.cluster = label GROUP BY 1")
def cluster_compactness(spark, sf):
    v = labelled(spark, sf)
    return clusters.compactness(v, clusters.centroids(v)).withColumn("compactness", F.round("compactness", 8))


@query("SELECT a.label AS cluster, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 7) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def intra_similarity(spark, sf):
    return clusters.intra_similarity(labelled(spark, sf)).withColumn("similarity", F.round("similarity", 7))


@query(f"{D_CENTERS}, s AS (SELECT label AS cluster, avg({D_DISTANCE}) AS s FROM embeddings JOIN l ON l.cluster = label GROUP BY 1), p AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda p: pow(p[1] - p[2], 2)))) AS d FROM l a JOIN l b ON a.cluster <> b.cluster), r AS (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY 1) SELECT round((SELECT avg(r) FROM r), 7) AS davies_bouldin, round((SELECT avg(d) FROM p WHERE a < b), 7) AS separation")
def davies_bouldin(spark, sf):
    v = labelled(spark, sf)
    return clusters.davies_bouldin(v, clusters.centroids(v)).select(F.round("davies_bouldin", 7).alias("davies_bouldin"), F.round("separation", 7).alias("separation"))


def filed(spark, sf) -> DataFrame:
    """Notes with a cluster, a folder and tags."""
    n = notes_of(spark, sf).select((F.col("seq") % 11).alias("cluster"), F.col("seq").alias("id"), "path", F.concat("lang", F.lit("/"), F.col("seq") % 3).alias("folder"), F.array(F.concat(F.lit("#"), "lang"), F.concat(F.lit("#t"), F.col("seq") % 4)).alias("tags"))
    return n


D_FILED = f"{WITH_NOTES}, f AS (SELECT seq % 11 AS cluster, seq AS id, path, concat(lang, '/', seq % 3) AS folder, ['#' || lang, '#t' || (seq % 4)] AS tags FROM notes)"
D_TAGGED = f"{D_FILED}, t AS (SELECT cluster, id, path, unnest(list_distinct(tags)) AS t FROM f), k AS (SELECT cluster, t, count(*) AS k FROM t GROUP BY 1, 2), z AS (SELECT cluster, count(*) AS n FROM f GROUP BY 1)"


@query(f"{D_TAGGED} SELECT cluster, round(max(k)::DOUBLE / max(n), 9) AS homogeneity FROM k JOIN z USING (cluster) GROUP BY 1")
def tag_homogeneity(spark, sf):
    return clusters.tag_homogeneity(filed(spark, sf)).withColumn("homogeneity", F.round("homogeneity", 9))


@query(f"{D_FILED}, k AS (SELECT cluster, folder, count(*) AS k FROM f GROUP BY 1, 2) SELECT cluster, round(max(k)::DOUBLE / sum(k), 9) AS coherence FROM k GROUP BY 1")
def folder_coherence(spark, sf):
    return clusters.folder_coherence(filed(spark, sf)).withColumn("coherence", F.round("coherence", 9))


def chain(spark, sf) -> DataFrame:
    """Links from each note to another of its cluster and to one of the next."""
    rows = notes_of(spark, sf).select("seq")
    return rows.select(F.col("seq").alias("source"), F.explode(F.array(F.col("seq") + 22, F.col("seq") + 1)).alias("target"))


D_CHAIN = f"{D_TAGGED}, e AS (SELECT id AS source, unnest([id + 22, id + 1]) AS target FROM f), i AS (SELECT a.cluster, count(*) AS k FROM e JOIN f a ON a.id = source JOIN f b ON b.id = target WHERE a.cluster = b.cluster GROUP BY 1)"


@query(f"{D_CHAIN}, d AS (SELECT cluster, string_agg(t, ',' ORDER BY t) AS tags FROM k JOIN z USING (cluster) WHERE k >= 0.3 * n GROUP BY 1), m AS (SELECT cluster, arg_min(folder, (-c, folder)) AS folder FROM (SELECT cluster, folder, count(*) AS c FROM f GROUP BY 1, 2) GROUP BY 1) SELECT z.cluster, n AS size, coalesce(tags, '') AS tags, folder, round(coalesce(i.k, 0)::DOUBLE / (n * (n - 1)), 9) AS link_density FROM z LEFT JOIN d USING (cluster) JOIN m USING (cluster) LEFT JOIN i USING (cluster)")
def cluster_traits(spark, sf):
    t = clusters.traits(filed(spark, sf), chain(spark, sf))
    return t.select("cluster", "size", F.array_join("dominant_tags", ",").alias("tags"), "folder", F.round("link_density", 9).alias("link_density"))


@query("WITH s AS (SELECT count(*) AS size FROM embeddings WHERE label < 7 OR vec_id % 3 = 0 GROUP BY label), r AS (SELECT size, row_number() OVER (ORDER BY size) AS r FROM s) SELECT round(2.0::DOUBLE * sum(r * size) / (count(*) * sum(size)) - (count(*) + 1)::DOUBLE / count(*), 9) AS gini, (SELECT round(count(*) FILTER (WHERE vec_id % 6 = 0)::DOUBLE / count(*), 9) FROM embeddings) AS noise_ratio FROM r")
def cluster_shape(spark, sf):
    e = read(spark, sf, "embeddings")
    sizes = e.where("label < 7 or vec_id % 3 = 0").groupBy("label").agg(F.count("*").alias("size"))
    noise = clusters.noise_ratio(e.select(F.when(F.col("vec_id") % 6 == 0, -1).otherwise(F.col("label")).alias("cluster")))
    return clusters.gini(sizes).crossJoin(F.broadcast(noise)).select(F.round("gini", 9).alias("gini"), F.round("noise_ratio", 9).alias("noise_ratio"))


@query("SELECT event_id, round(0.35 * (s + 1) / 2 + 0.2 * (1 - n) + 0.15 * n + 0.15 * n + 0.1 * CASE WHEN c < 50 THEN c / 50.0 WHEN c > 500 THEN 500.0 / c ELSE 1 END + 0.05 * (1 - n), 9) AS score FROM (SELECT event_id, (event_id % 200 - 100) / 100.0::DOUBLE AS s, (event_id % 10) / 10.0::DOUBLE AS n, (event_id % 700 + 1)::DOUBLE AS c FROM events)")
def clustering_scores(spark, sf):
    k = F.col("event_id")
    s, n, c = (k % 200 - 100) / F.lit(100.0), (k % 10) / F.lit(10.0), (k % 700 + 1).cast("double")
    return read(spark, sf, "events").select("event_id", F.round(clusters.composite(s, n, n, n, c, n), 9).alias("score"))


@query(f"{D_TAGGED}, b AS (SELECT path, arg_min(t.t, (-k, t.t)) AS t FROM t JOIN k ON k.cluster = t.cluster AND k.t = t.t GROUP BY 1) SELECT path, concat(cluster, '/', b.t) AS cluster FROM f JOIN b USING (path)")
def clusters_by_tag(spark, sf):
    return clusters.split_by_tag(filed(spark, sf).select("path", F.col("cluster").cast("string").alias("cluster"), "tags"))


@query(f"{WITH_NOTES} SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS cluster FROM notes")
def clusters_by_folder(spark, sf):
    return clusters.by_folder(notes_of(spark, sf))


@query("WITH RECURSIVE n AS (SELECT doc_id AS id, doc_id % 6 AS cluster FROM documents), e AS (SELECT a.id AS s, b.id AS t FROM n a JOIN n b ON b.id = a.id + 6 WHERE a.id % 48 < 36), u AS (SELECT s, t FROM e UNION ALL SELECT t, s FROM e), r AS (SELECT id, id AS c FROM n UNION SELECT u.t, r.c FROM r JOIN u ON u.s = r.id) SELECT id::VARCHAR AS path, cluster, min(c) AS component FROM r JOIN n USING (id) GROUP BY 1, 2")
def clusters_by_links(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 6).alias("cluster"))
    e = d.where("path % 48 < 36").select(F.col("path").alias("source"), (F.col("path") + 6).alias("target")).unionAll(d.select(F.col("path").alias("source"), (F.col("path") + 1).alias("target")))
    return clusters.link_components(d, e).select(F.col("path").cast("string").alias("path"), "cluster", "component")


@query("SELECT doc_id, CASE WHEN n < 20 THEN 'misc' ELSE source END AS cluster FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM (SELECT doc_id, coalesce(source, 'none') AS source FROM documents))")
def clusters_resized(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("source", F.lit("none")).alias("cluster"))
    out = clusters.resized(d, 20, 200)
    return out.select(F.col("path").alias("doc_id"), F.substring_index("cluster", "#", 1).alias("cluster"))


@query("WITH k AS (SELECT cluster, w, count(*) AS tf FROM (SELECT doc_id % 5 AS cluster, unnest(['w' || (doc_id % 7), 'v' || (doc_id % 5), 'all']) AS w FROM documents) GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM k GROUP BY 1), r AS (SELECT cluster, w, row_number() OVER (PARTITION BY cluster ORDER BY round(tf * ln((5 + 1)::DOUBLE / (df + 1)), 9) DESC, w) AS r FROM k JOIN d USING (w)) SELECT cluster, string_agg(w, ',' ORDER BY r) AS keywords FROM r WHERE r <= 2 GROUP BY 1")
def cluster_keywords(spark, sf):
    k = F.col("doc_id")
    n = read(spark, sf, "documents").select(k.alias("path"), (k % 5).alias("cluster"), F.concat(F.lit("W"), k % 7, F.lit(" V"), k % 5, F.lit(", all")).alias("title"))
    return clusters.title_keywords(n, 2).select("cluster", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 0 ELSE doc_id % 4 END AS cluster FROM documents")
def clusters_merged(spark, sf):
    """Cluster 1 has most of cluster 0's tags and fewer notes or a later name; the others share none."""
    k = F.col("doc_id")
    tags = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("d"))).otherwise(F.array(F.lit("e")))
    n = read(spark, sf, "documents").select(k.alias("path"), (k % 4).alias("cluster"), tags.alias("tags"))
    extra = n.where("cluster = 0").limit(1).select((F.col("path") + 10_000_000_000).alias("path"), "cluster", "tags")
    return clusters.merge_by_tags(n.unionAll(extra)).where("path < 10000000000").select(F.col("path").alias("doc_id"), "cluster")


@query("WITH o AS (SELECT label::BIGINT AS c, vec_id AS id FROM embeddings), n AS (SELECT CASE WHEN vec_id % 4 = 0 THEN (label + 3) % 10 WHEN label < 3 THEN vec_id % 20 ELSE label + 10 END::BIGINT AS c, vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0), b AS (SELECT o.c AS o, n.c AS n, count(*) AS k FROM o JOIN n USING (id) GROUP BY 1, 2), s AS (SELECT o, n, k / (so + sn - k)::DOUBLE AS j FROM b JOIN (SELECT c AS o, count(*) AS so FROM o GROUP BY 1) USING (o) JOIN (SELECT c AS n, count(*) AS sn FROM n GROUP BY 1) USING (n)), m AS (SELECT o, n, j FROM s QUALIFY row_number() OVER (PARTITION BY o ORDER BY j DESC, n) = 1) SELECT x.o AS concept_id, CASE WHEN j > 0.2 THEN n ELSE -1 END AS cluster, CASE WHEN j > 0.2 AND j < 0.6 THEN concat('new ', n) ELSE concat('old ', x.o) END AS name, CASE WHEN j > 0.6 THEN 'renamed' WHEN j > 0.2 THEN 'remapped' ELSE 'dissolved' END AS change FROM (SELECT DISTINCT c AS o FROM o) x LEFT JOIN m ON m.o = x.o")
def concepts_evolved(spark, sf):
    old, new = memberships(spark, sf)
    tracked = old.select(F.col("cluster").alias("concept_id"), "cluster", F.concat(F.lit("old "), "cluster").alias("name")).distinct()
    names = new.select("cluster", F.concat(F.lit("new "), "cluster").alias("name")).distinct()
    out = clusters.evolve(tracked, old.withColumnRenamed("cluster", "concept_id"), new, names)
    return out.select("concept_id", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"), "name", "change")


@query("SELECT n_nationkey AS concept_id, CASE WHEN n_nationkey % 3 = 0 THEN 'dissolved' WHEN n_nationkey % 3 = 1 THEN 'renamed' ELSE 'created' END AS change FROM nation WHERE n_nationkey % 6 <> 4")
def concept_changes(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("concept_id"), F.col("n_name").alias("name"))
    old = n.where("concept_id % 3 <> 2")
    new = n.where("concept_id % 3 <> 0").withColumn("name", F.when(F.col("concept_id") % 6 == 4, F.col("name")).otherwise(F.lower("name")))
    return clusters.concept_changes(old, new).select("concept_id", "change")


@query("SELECT count(*) FILTER (WHERE doc_id % 10 = 0 OR doc_id % 9 = 0) AS changed, count(*) FILTER (WHERE doc_id % 10 <> 0) AS total, true AS refit FROM documents")
def refit_needed(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("h").alias("content_hash"))
    new = d.where("id % 10 <> 0").withColumn("content_hash", F.when(F.col("id") % 9 == 0, "x").otherwise("h"))
    return clusters.needs_refit(d, new)


@query(f"SELECT event_id, round(0.25 * least(1.0, (event_id % 9) * 0.15) + 0.25 * least(1.0, (event_id % 14) / 10.0) + 0.3 * CASE WHEN d < 7 THEN 1.0 WHEN d < 30 THEN 0.7 WHEN d < 90 THEN 0.5 ELSE 0.1 END, 9) AS score FROM (SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE AS d FROM events)".replace("least(1.0, (event_id % 9) * 0.15)", "least(1.0::DOUBLE, (event_id % 9) * 0.15::DOUBLE)").replace("least(1.0, (event_id % 14) / 10.0)", "least(1.0::DOUBLE, (event_id % 14) / 10.0::DOUBLE)"))
def cold_start_scores(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.round(review.cold_start(F.col("event_id") % 9, F.col("event_id") % 14, F.col("ts"), now()), 9).alias("score"))


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 3 * 86400000000::BIGINT")
def modified_within(spark, sf):
    e = read(spark, sf, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    return review.modified_within(e, last, 3, "ts").select("event_id")


@query("SELECT event_id AS question_id FROM events WHERE event_id % 4 = 0 OR epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) >= 7 * 86400000000::BIGINT")
def stale_questions(spark, sf):
    e = read(spark, sf, "events")
    held = e.select(F.col("event_id").alias("question_id"), F.col("event_id").alias("note_id"), F.lit("h").alias("content_hash"), F.col("ts").alias("created_at"))
    notes = e.select(F.col("event_id").alias("note_id"), F.when(F.col("event_id") % 4 == 0, "changed").otherwise("h").alias("content_hash"))
    return review.stale_questions(held, notes, F.lit(e.agg(F.max("ts")).first()[0]), 7).select("question_id")


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE length(content) >= 100 AND list_has_any({D_TAGS}, ['#en', '#de'])")
def worth_asking(spark, sf):
    n = notes_of(spark, sf)
    return n.where(review.worth_asking(F.length("content"), markdown.tags(F.col("content")), ["#en", "#de"])).select("path")


@query(f"{WITH_NOTES} SELECT path FROM notes WHERE regexp_full_match(path, '(?:src1|src2)/.*|[^/]*/(?:en|fr)/.*') AND NOT regexp_full_match(path, '[^/]*/fr/(?:Doc 1)[^/]*\\.md')")
def extended_globs(spark, sf):
    return globs.exclude(globs.include(notes_of(spark, sf), ["@(src1|src2)/**", "*/+(en|fr)/**"]), ["*/fr/@(Doc 1)*.md"]).select("path")


@query()
def review_sample(spark, sf):
    """Forty notes of three bands, weighted by score; hashes of the engine decide, so there is no SQL form."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("note_id"), (F.col("value") / 100).alias("score"))
    return review.sample(e, 40, 7).select("note_id", "band")


# --- what needs more than one pass: density, layout, admission, saved streams, numbers over a whole table ---


@query()
def density_clusters(spark, sf):
    """Clusters of all embeddings by density; compared with brute force in the tests."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return density.density_clusters(e).withColumnRenamed("id", "vec_id")


@query()
def reduced_vectors(spark, sf):
    """All embeddings in ten dimensions; a drawing, so there is no SQL form."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return layout.reduced(e, rounds=15).withColumnRenamed("id", "vec_id")


D_PAIRS = "SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3"


@query(f"SELECT vec_id, own AS cluster, round(coalesce((min(d) FILTER (WHERE own <> other) - max(d) FILTER (WHERE own = other)) / greatest(min(d) FILTER (WHERE own <> other), max(d) FILTER (WHERE own = other)), 0), 7) AS silhouette FROM ({D_PAIRS}) GROUP BY 1, 2")
def silhouettes(spark, sf):
    return clusters.silhouette(labelled(spark, sf)).select(F.col("id").alias("vec_id"), "cluster", F.round("silhouette", 7).alias("silhouette"))


D_ADMITTED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), r AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS taken, 0::BIGINT AS n, 0::BIGINT AS t, 0::BIGINT AS first FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, event_id, CASE WHEN len(live) < 4 THEN list_append(live, t) ELSE live END, len(live), t, coalesce(live[1], 0) FROM (
    SELECT e.user_id, e.i, e.event_id, e.t, list_filter(r.taken, lambda x: x > e.t - 172800000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
)
SELECT user_id, event_id, n AS in_window, n < 4 AS allowed, CASE WHEN n < 4 THEN 0.0 ELSE (first + 172800000000 - t) / 1000000.0::DOUBLE END AS wait_seconds FROM r WHERE i > 0
"""


@query(D_ADMITTED)
def requests_admitted(spark, sf):
    """Four requests of a user in any two days."""
    return limits.admitted(read(spark, sf, "events"), "user_id", "event_id", seconds=172_800, most=4).drop("ts")


@query(f"SELECT conversation_id, seq, role, content FROM ({D_SPOKEN}) UNION ALL SELECT conversation_id, max(seq) + 1, 'user', 'why?' FROM ({D_SPOKEN}) WHERE {D_NEW} GROUP BY 1 UNION ALL SELECT conversation_id, max(seq) + 2, 'assistant', 'because' FROM ({D_SPOKEN}) WHERE {D_NEW} GROUP BY 1")
def streams_saved(spark, sf):
    """The exchanges of ``exchanges_saved`` in two epochs, the later one first and then replayed."""
    c, m = conversation_tables(spark, sf)
    later = F.lit("2030-01-01").cast("timestamp")
    store = saving.ConversationStore(spark, fresh(spark, "conversations"), 8)
    store.create(c.withColumn("created_at", later), m.withColumn("timestamp", later))
    x = exchanges(spark, sf).withColumn("exchange_id", F.concat(F.lit("x"), "conversation_id")).withColumn("timestamp", later)
    for epoch, part in ((1, x.where("conversation_id % 2 = 1")), (0, x.where("conversation_id % 2 = 0")), (2, x.where("conversation_id % 2 = 1"))):
        store.save(part, epoch)
    return store.messages().select(F.col("conversation_id").cast("bigint").alias("conversation_id"), "seq", "role", "content")


D_ASKED = "SELECT doc_id, right(path, 3 + (doc_id * 7 % 20)::INT) AS s FROM notes JOIN documents ON doc_id = seq"


@query(f"{WITH_NOTES}, asked AS ({D_ASKED}) SELECT s AS source, arg_min(path, seq) AS path FROM (SELECT DISTINCT s FROM asked) JOIN notes ON ends_with(path, s) GROUP BY 1")
def question_sources(spark, sf):
    """Sources that are ends of paths, among all notes."""
    n = notes_of(spark, sf).select("path", F.col("seq").alias("place"))
    asked = n.select(F.right("path", 3 + F.col("place") * 7 % 20).alias("sourceNotePath"))
    return model_json.source_paths(asked, n).select(F.col("sourceNotePath").alias("source"), F.col("source").alias("path"))


@query(f"{WITH_NOTES} SELECT path, row_number() OVER (ORDER BY path) - 1 AS row, (row_number() OVER (ORDER BY path) - 1) // 128 AS batch FROM notes")
def batches_over_all(spark, sf):
    rows = numbering.numbered(notes_of(spark, sf).select("path"), "row", ["path"])
    return rows.select("path", "row", F.floor(F.col("row") / 128).alias("batch"))


@query(SQL["note_search"])
def note_search_indexed(spark, sf):
    """The rows of ``note_search`` from an index of grams."""
    n = notes_of(spark, sf).select("path", F.concat(F.lit("Doc "), "seq").alias("title"), markdown.tags(F.col("content")).alias("tags"))
    index = noteindex.NoteIndex(spark, fresh(spark, "note-index"), 8)
    index.put(n)
    return index.search("Doc 12").select("path")
