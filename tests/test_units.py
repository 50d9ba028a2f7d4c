"""Literal cases of functions and operators."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notelake.functions import globs, json, markdown, scores, text
from notelake.operators import cache, clusters, documents, linkgraph, review, rollups, search
from notelake.operators.search import top_k
from notelake.plans import prompts, providers, relevance
from notelake.sources import notes as notes_source
from notelake.streaming import events


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], "id").select(column.alias("x")).first()["x"]


def text_of(spark, f, value):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [("", "00001505"), ("test", "7c9e6865"), ("Étion", "1675a6c8"), ("你好世界🌍", "af94158d")])
def test_djb2(spark, value, want):
    assert text_of(spark, text.djb2, value) == want


def test_content_hash(spark):
    h = lambda s: text_of(spark, text.content_hash, s)
    assert h("a  b\n") == h(" a b") != h("a bc")
    assert h("x" * 2000) != h("x" * 2001)
    assert len(h("word " * 900)) == 8


@pytest.mark.parametrize("value,want", [("", 0), ("abc", 2), ("你" * 10, 10), ("你好ab", 4)])
def test_tokens(spark, value, want):
    assert text_of(spark, text.estimate_tokens, value) == want


def test_truncate(spark):
    cut = text_of(spark, lambda c: text.truncate(c, 100), "One sentence here. " * 40)
    assert cut.endswith(text.TRUNCATED) and cut.removesuffix(text.TRUNCATED).endswith(".")
    assert text_of(spark, lambda c: text.truncate(c, 100), "short") == "short"


@pytest.mark.parametrize(
    "f,value,want",
    [
        (markdown.strip_frontmatter, "---\na: 1\n---\nbody", "body"),
        (markdown.summarize_code, "a\n```js\nx\n```\nb\n```\ny\n```", "a\n[code: js]\nb\n[code: code]"),
        (markdown.summarize_code, "`inline`", "`inline`"),
        (markdown.summarize_images, "![](a.png) ![ b ](c) [l](m)", "[image: image] [image: b] [l](m)"),
        (markdown.normalize_whitespace, "  a\r\n\n\n\n\n  b \t c ", "a\n\nb c"),
    ],
)
def test_markdown(spark, f, value, want):
    assert text_of(spark, f, value) == want


def test_metadata(spark):
    note = '---\ntags: [x, "#y"]\ncount: 42\ncount: 43\n---\n# One\n```\n#no\n```\n`#no2` #deep/tag [[A|b]] [[A#h]] [[#h]] [[ B ]]\n### Two  \n####### no\n## CR\r'
    row = spark.createDataFrame([(note,)], "c string").select(*markdown.metadata(F.col("c"))).first()
    assert row.tags == ["#x", "#y", "#deep/tag", "#h"]
    assert row.links == ["A", "B"]
    assert [(h.heading, h.level, h.line) for h in row.headings] == [("One", 1, 6), ("Two", 3, 11)]
    assert row.frontmatter == {"tags": '[x, "#y"]', "count": "43"}


@pytest.mark.parametrize("s,want", [(-1.0, 0), (-0.5, 25), (0.0, 50), (0.33, 67), (0.5, 75), (1.0, 100), (2.0, 100), (-2.0, 0)])
def test_score(spark, s, want):
    assert one(spark, scores.to_score(F.lit(s))) == want


def test_dot(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scores.dot(v(0.6, 0.8, 0.0), v(0.8, 0.6, 0.0))) == pytest.approx(0.96)
    assert one(spark, scores.dot(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0
    with pytest.raises(PySparkException):
        one(spark, scores.dot(v(1.0, 2.0, 3.0), v(1.0, 2.0)))


def test_top_k(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-0.8, 0.0]), (3, [1.0, 0.0]), (4, [-0.9, 0.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in top_k(e, [1.0, 0.0], 9).collect()] == [1, 3, 2, 4]
    assert top_k(e, [1.0, 0.0], 0).count() == 0


def test_many_queries_go_in_blocks(spark, monkeypatch):
    v = [(i, [float(i % 7), float(i % 5)], i % 2) for i in range(40)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(i, x) for i, x, _ in v] + [(3, v[3][1])] * 20, "query_id long, query array<double>")
    whole, best = (sorted(map(tuple, search.similarities(e.drop("label"), q).collect())), sorted(map(tuple, search.top_k_each(e, q.distinct(), 3, ["label"]).collect())))
    monkeypatch.setattr(search, "MOST_QUERIES", 7)
    assert all(b.count() <= 7 for b in search.blocks(q)) and len(search.blocks(q)) > 8
    assert sorted(map(tuple, search.similarities(e.drop("label"), q).collect())) == whole and len(whole) == 60 * 40
    assert sorted(map(tuple, search.top_k_each(e, q.distinct(), 3, ["label"]).collect())) == best


@pytest.mark.parametrize(
    "glob,path,want",
    [
        ("Templates/**", "Templates/a/b.md", True), ("Templates/**", "notes/a.md", False), ("*.template.md", "x.template.md", True), ("*.template.md", "a/x.template.md", False),
        ("**/*.template.md", "a/x.template.md", True), ("**/*.template.md", "x.template.md", True), (".config/**", ".config/x", True), ("a?[bc].md", "axb.md", True), ("{a,b}/*.md", "b/x.md", True), ("!a/**", "b/x", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert one(spark, globs.matches(F.lit(path), [glob])) is want


def test_glob_syntax():
    assert globs.parse_patterns("# c\n a/** \n\nb") == ["a/**", "b"]
    assert globs.literal_prefix("Templates/x*") == "Templates/x"
    for bad in ("@(a|b", "[a", "{a"):
        with pytest.raises(ValueError):
            globs.to_regex(bad)


def test_json(spark):
    rows = spark.createDataFrame([('```json\n[{"notePath":"a","score":150,"reason":"r"},{"notePath":"b","score":"9","reason":"r"},3]\n```',), ("```json\n[1,]\n```",), ("none",)], "response string")
    assert [(r.note_path, r.score) for r in json.scores(rows).collect()] == [("a", 100.0)]
    assert text_of(spark, json.goal_draft, '```json\n{"name":"n"}\n```') is None


def test_yaml_round_trip():
    fields = {"id": "1", "name": 'a: "b"\n\\n', "n": 3, "ok": True, "none": None, "list": ["x", "2"], "stones": [{"id": "m", "order": 0}, {"id": "k", "done": False}], "obj": {"a": 1}}
    assert documents.parse_yaml(documents.write_yaml(fields)) == fields


def test_documents(spark):
    good = "---\nid: c1\ngoalId: g\ntopic: t\ncreatedAt: now\n---\n# Conversation\n\n\n---\n\n## User - t1\n\nhello\n\nSources: a.md, b.md\n\n---\n\n## Assistant - t2\n\n"
    rows = documents.load(spark.createDataFrame([(good,), ("broken",)], "content string"), documents.CONVERSATION)
    assert documents.rejects(rows).count() == 1
    row = documents.accepted(rows).select("fields.topic", documents.messages(F.col("body")).alias("m")).first()
    assert row.topic == "t" and [(m.role, m.content, m.sources) for m in row.m] == [("user", "hello", ["a.md", "b.md"])]
    saved = spark.createDataFrame([("---\nid: 'x'\n---broken\n## User - t\n\nhi",)], "c string").select(documents.recover(F.col("c"), F.lit("d")).alias("r")).first().r
    assert saved.id == "x" and saved.topic == "Recovered Discussion"


def test_upsert_and_replace(spark):
    t = spark.createDataFrame([(1, "a", "d", "old"), (2, "b", "e", "old")], "id int, name string, created_at string, updated_at string")
    n = spark.createDataFrame([(2, "B", "new"), (3, "c", "new")], "id int, name string, created_at string")
    got = {r.id: tuple(r) for r in documents.upsert(t, n, "id", ("created_at",), F.lit("now")).collect()}
    assert got == {1: (1, "a", "d", "old"), 2: (2, "B", "e", "now"), 3: (3, "c", "new", "now")}


def test_cache(spark, tmp_path):
    c = cache.EmbeddingCache(spark, str(tmp_path / "cache"), "p", "m")
    row = lambda h, t: spark.createDataFrame([("a", h, [1.0], dt.datetime(2024, 1, t), 3)], "path string, content_hash string, embedding array<float>, created_at timestamp, token_count int")
    c.set(row("h1", 1))
    c.set(row("h2", 2))
    assert [r.content_hash for r in c.get().collect()] == ["h2"]
    assert cache.EmbeddingCache(spark, str(tmp_path / "cache"), "p", "other").get().count() == 0
    assert c.stats().first().tokens == 3
    c.invalidate(spark.createDataFrame([("a",)], "path string"))
    assert c.paths().count() == 0


def test_cold_and_warm_runs_agree(spark):
    notes = spark.createDataFrame([("a.md", "typescript types"), ("b.md", "cooking pasta"), ("goals/x.md", "typescript"), ("c.md", "  ")], "path string, content string")
    empty = spark.createDataFrame([], "path string, content_hash string, embedding array<float>")
    p, draft = providers.OfflineEmbeddings(32), relevance.Draft("typescript", "types", ["one"])
    cold = relevance.embedded(notes, empty, p)
    stored = spark.createDataFrame(cold.select("path", "content_hash", "embedding").collect(), "path string, content_hash string, embedding array<float>")
    a, b = (relevance.score_notes(notes, held, p, draft).select("path", "score").collect() for held in (empty, stored))
    assert a == b and {r.path for r in a} == {"a.md", "b.md"}


def test_edits_outside_the_prepared_text_are_misses(spark):
    long = "word " * 9000
    old = [("code.md", "a\n```\nx = 1\n```\nb"), ("front.md", "---\ntitle: a\n---\nb"), ("image.md", "a ![p](one.png) b"), ("tail.md", long + "one"), ("same.md", "a b")]
    new = [("code.md", "a\n```\nx = 2\n```\nb"), ("front.md", "---\ntitle: c\n---\nb"), ("image.md", "a ![p](two.png) b"), ("tail.md", long + "two"), ("same.md", "a b")]
    of = lambda rows: spark.createDataFrame(rows, "path string, content string")
    p = providers.OfflineEmbeddings(8)
    cold = relevance.embedded(of(old), spark.createDataFrame([], "path string, content_hash string, embedding array<float>"), p)
    held = spark.createDataFrame(cold.select("path", "content_hash", "embedding").collect(), "path string, content_hash string, embedding array<float>")
    assert {r.path: r.from_cache for r in relevance.embedded(of(new), held, p).collect()} == {"code.md": False, "front.md": False, "image.md": False, "tail.md": False, "same.md": True}


def test_retries():
    class Status(Exception):
        def __init__(self, status):
            self.status = status

    waits, calls = [], []

    def call():
        calls.append(1)
        raise Status(429)

    with pytest.raises(Status):
        providers.with_retries(call, sleep=waits.append)
    assert waits == [1.0, 2.0] and len(calls) == 3
    assert not providers.retryable(Status(401)) and providers.retryable(Status(503)) and providers.retryable(Exception("Network down"))


def test_chat(spark):
    class Echo:
        def chat(self, messages):
            if messages[-1]["content"] == "fail":
                raise ValueError("no")
            return "|".join(f"{m['role']}:{m['content']}" for m in messages)

    m = spark.createDataFrame([(1, 0, "system", "be"), (1, 2, "user", "hi"), (1, 1, "system", "kind"), (2, 0, "user", "fail")], "conversation_id int, seq int, role string, content string")
    bodies = prompts.request_bodies(m)
    assert bodies.where("conversation_id = 1").first().max_tokens == prompts.MOST_TOKENS
    got = {r.conversation_id: (r.response, r.error) for r in providers.chat(bodies, Echo(), "conversation_id").collect()}
    assert got == {1: ("system:be\n\nkind|user:hi", None), 2: (None, "request failed")}


def test_upserts_of_a_batch(spark):
    seen = []
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    events.upsert_each_batch(lambda d, e: seen.extend(sorted(map(tuple, d.collect()))), "k", "t")(df, 0)
    assert seen == [("a", 2, "y"), ("b", 1, "z")]


def test_link_resolution(spark):
    notes = spark.createDataFrame([(0, "x/A.md", "[[A]] [[x/A]] [[B|b]] [[gone]]"), (1, "A.md", "[[y/B.md]]"), (2, "y/B.md", "")], "seq int, path string, content string")
    got = {(r.source, r.target): r.n for r in linkgraph.resolved(notes).collect()}
    assert got == {("x/A.md", "A.md"): 1, ("x/A.md", "x/A.md"): 1, ("x/A.md", "y/B.md"): 1, ("A.md", "y/B.md"): 1}


def test_notes_tree(spark, tmp_path):
    for p in ("a.md", "d/b c.md", ".hidden/x.md", "d/node_modules/y.md", "d/z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("hi")
    got = {r.path: (r.basename, r.folder) for r in notes_source.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("a", ""), "d/b c.md": ("b c", "d")}


def test_key_values(spark, tmp_path):
    kv = notes_source.KeyValueStore(spark, str(tmp_path / "kv"))
    kv.write("a", {"x": 1})
    kv.write("a", [2])
    assert kv.read("a") == [2] and kv.read("b") is None and kv.exists("a")
    kv.clear()
    assert kv.keys().count() == 0


def test_note_mutations(spark):
    t = spark.createDataFrame([("f/a.md", "1"), ("b.md", "2")], "path string, content string")
    new = spark.createDataFrame([("b.md", "3"), ("c.md", "4")], "path string, content string")
    assert {tuple(r) for r in notes_source.create(t, new).collect()} == {("f/a.md", "1"), ("b.md", "2"), ("c.md", "4")}
    assert notes_source.delete_folder(t, "f").count() == 1
    with pytest.raises(PySparkException):
        notes_source.modify(t, new).collect()


def test_roll_ups(spark):
    q = spark.createDataFrame([("s", k, k) for k in (0, 1)], "session_id string, question_id int, ordinal int")
    a = spark.createDataFrame([("s", 0, True)], "session_id string, question_id int, is_correct boolean")
    r = rollups.quiz_scores(q, a).first()
    assert (r.score, r.incorrect, r.completed) == (50, 1, False)
    assert rollups.first_unanswered(q, a).first().position == 1
    assert rollups.new_answers(a, a).count() == 0
    assert one(spark, scores.progress(F.lit(0), F.lit(0))) is None


def test_review(spark):
    d = lambda k: dt.datetime(2024, 1, k)
    a = spark.createDataFrame([("n", i, d(i + 1), c) for i, c in enumerate((True, False, True, True))], "note_id string, event_id int, ts timestamp, correct boolean")
    h = review.note_history(a).first()
    assert (h.quiz_count, h.correct_count, h.streak, len(h.recent)) == (4, 3, 2, 4)
    scored = spark.createDataFrame([(i, i / 100) for i in range(100)], "note_id int, score double")
    assert review.sample(scored, 20).count() == 20


def test_cluster_helpers(spark):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.8, 0.6]), (1, 3, [0.0, 1.0])], "cluster int, id int, embedding array<double>")
    c = clusters.centroids(v)
    assert {r.id: r.cluster for r in clusters.assign(v, c).collect()} == {1: 0, 2: 0, 3: 1}
    assert clusters.gini(spark.createDataFrame([(1,), (1,)], "size int")).first().gini == pytest.approx(0)
    made, silhouette = clusters.kmeans(v.select("id", "embedding"), 2)
    assert made.count() == 3 and -1 <= silhouette <= 1


def test_stream_equals_batch(spark, tmp_path):
    lines = [("s", i, x) for i, x in enumerate(['data: {"type":"message_start","message":{"usage":{"input_tokens":7}}}', "event: x", 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"He"}}', "data: {broken", 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"y"}}', 'data: {"type":"message_delta","usage":{"output_tokens":2}}', "data: [DONE]"])]
    df = spark.createDataFrame(lines, "stream_id string, seq int, line string")
    batch = events.fold(df).first()
    assert (batch.content, batch.input_tokens, batch.output_tokens, batch.errors, batch.failed) == ("Hey", 7, 2, 1, False)
    df.write.parquet(str(tmp_path / "in"))
    q = events.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.sql("select content, input_tokens, output_tokens, errors from folded").first()) == ("Hey", 7, 2, 1)


def test_rate_window_leaves_its_start_out(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("k", base), ("k", base + dt.timedelta(seconds=60))]
    got = events.rate_window(spark.createDataFrame(rows, "k string, ts timestamp"), "k", most=1).orderBy("ts").collect()
    assert [r.in_window for r in got] == [1, 1]


def test_streams_cut_anywhere_and_out_of_order(spark, tmp_path):
    """Chunks cut within lines, that come in three triggers in the wrong order; the last line has no break."""
    events_ = ['{"type":"message_start","message":{"usage":{"input_tokens":7}}}', '{"type":"content_block_delta","delta":{"type":"text_delta","text":"He"}}', "{broken", '{"type":"content_block_delta","delta":{"type":"text_delta","text":"llo"}}', '{"type":"message_delta","usage":{"output_tokens":3}}', "[DONE]"]
    whole = "event: x\n\n" + "\n".join("data: " + e for e in events_) + "\n"
    chunks = [whole[i : i + 23] for i in range(0, len(whole), 23)]
    rows = [("s", k, c) for k, c in enumerate(chunks)]
    schema = "stream_id string, seq long, chunk string"
    whole_df = spark.createDataFrame(rows, schema)
    batch = events.fold(events.lines_of(whole_df)).first()
    assert (batch.content, batch.input_tokens, batch.output_tokens, batch.errors) == ("Hello", 7, 3, 1)
    tail = spark.createDataFrame([("t", 0, whole[:-8])], schema)
    assert events.fold(events.lines_of(tail)).first().content == "Hello"
    src = tmp_path / "in"
    out = []
    for part in (rows[6:], rows[:2], rows[2:6]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = events.fold_stream(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.content, r.ended) for r in out][-1] == ("Hello", True) and out[0].content == ""
    assert (out[-1].input_tokens, out[-1].output_tokens, out[-1].errors) == (7, 3, 1)


def test_a_second_search_asks_nobody(spark, tmp_path):
    calls = tmp_path / "calls"

    class Counting:
        batch_size = 2

        def __init__(self, log):
            self.log = log

        def embed(self, texts):
            with open(self.log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [([float(len(t)), 1.0], None) for t in texts]

    notes = spark.createDataFrame([(f"n{i}.md", "word " * (i + 1)) for i in range(5)] + [("goals/g/goal.md", "own"), ("t/x.md", "left out")], "path string, content string")
    held = cache.EmbeddingCache(spark, str(tmp_path / "cache"), "p", "m", 4)
    told = []
    draft = relevance.Draft("n", "d")
    first = relevance.score_notes(notes, held, Counting(str(calls)), draft, [], ["t/**"], 3, progress=lambda *x: told.append(x)).collect()
    texts = sum(map(int, calls.read_text().split()))
    assert texts == 5 + 1 and len(first) == 3 and held.get().count() == 5
    assert [x[0] for x in told] == ["indexing", "indexing", "searching", "searching"]
    again = relevance.score_notes(notes, held, Counting(str(calls)), draft, [], ["t/**"], 3).collect()
    assert again == first and sum(map(int, calls.read_text().split())) == texts + 1  # the goal alone
    edited = notes.where("path <> 'n0.md'").unionAll(spark.createDataFrame([("n0.md", "else")], "path string, content string"))
    relevance.score_notes(edited, held, Counting(str(calls)), draft, [], ["t/**"], 3)
    assert sum(map(int, calls.read_text().split())) == texts + 1 + 2
    assert relevance.score_notes(notes.limit(0), held, Counting(str(calls)), draft).count() == 0


def test_a_failed_write_changes_nothing(spark, tmp_path):
    held = cache.EmbeddingCache(spark, str(tmp_path / "cache"), "p", "m", 4)
    row = "path string, content_hash string, embedding array<float>, token_count int, created_at timestamp"
    at = dt.datetime(2030, 1, 1)
    held.set(spark.createDataFrame([(f"n{i}", "h", [1.0], i, at) for i in range(20)], row))
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    bad = spark.createDataFrame([("n1", "new", [1.0], 1, at)], row).withColumn("content_hash", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        held.set(bad)
    assert held.get().count() == 20 and {str(p): p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")} == before
    held.set(spark.createDataFrame([("n1", "new", [1.0], 1, dt.datetime(2031, 1, 1))], row))
    after = {str(p) for p in (tmp_path / "cache").rglob("*.parquet")}
    assert len(after & before.keys()) == 3 and held.get().where("content_hash = 'new'").count() == 1  # three of four partitions untouched


def test_missing_notes_are_errors(spark):
    notes = spark.createDataFrame([("a.md", "x")], "path string, content string")
    wanted = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert notes_source.readable(wanted("a.md"), notes).count() == 1
    with pytest.raises(Exception, match="no such note: b.md"):
        notes_source.readable(wanted("a.md", "b.md"), notes).collect()


def test_bands_of_a_sample(spark):
    scored = spark.createDataFrame([(i, i / 300) for i in range(300)], "note_id long, score double")
    got = review.sample(scored, 20, 3)
    assert sorted(r["count"] for r in got.groupBy("band").count().collect()) == [5, 7, 8] and got.select("note_id").distinct().count() == 20
    assert got.exceptAll(review.sample(scored, 20, 3)).count() == 0


@pytest.mark.parametrize("glob,path,want", [("@(a|b)/x.md", "b/x.md", True), ("@(a|b)/x.md", "c/x.md", False), ("+(ab)/*", "abab/x", True), ("a?(b).md", "a.md", True), ("*(x).md", "xx.md", True), ("!(a|b)/*.md", "c/x.md", True), ("!(a|b)/*.md", "a/x.md", False)])
def test_extended_globs(spark, glob, path, want):
    assert one(spark, globs.matches(F.lit(path), [glob])) is want


@pytest.mark.parametrize(
    "glob,path,want",
    [
        ("a**", "abc", True), ("a**", "ab/c", False), ("a**/x.md", "ab/c/x.md", False), ("a**/x.md", "ab/x.md", True), ("**b/x", "ab/x", True), ("**b/x", "c/ab/x", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("{a/**,b}", "a/c/d", True),
        ("n{1..3}.md", "n2.md", True), ("n{1..3}.md", "n4.md", False), ("n{3..1}.md", "n1.md", True), ("{a..c}/x", "b/x", True), ("{a..c}/x", "d/x", False), ("n{-1..1}", "n-1", True), ("{a..3}", "{a..3}", True),
        ("[[:digit:]].md", "7.md", True), ("[[:digit:]].md", "x.md", False), ("[![:digit:]_].md", "7.md", False), ("[![:digit:]_].md", "x.md", True), ("[[:alpha:][:digit:]-].md", "-.md", True), ("[[:upper:]]*", "ab", False), ("[]a].md", "].md", True),
    ],
)
def test_globs_of_segments_ranges_and_classes(spark, glob, path, want):
    assert one(spark, globs.matches(F.lit(path), [glob])) is want


def test_ranges_are_bounded():
    with pytest.raises(ValueError):
        globs.to_regex("{1..100000}")


@pytest.mark.parametrize(
    "text_,want",
    [
        ("a\x01b\x02 ![ x\x01 ](u) \x01\x02", "a\x01b\x02 [image: x\x01] \x01\x02"),
        ("![](u)![ \t](v)![y](w)z", "[image: image][image: image][image: y]z"),
        ("!![](x)(y)", "![image: image](y)"),
        ("![](a![b](c)", "[image: image]"),
        ("none", "none"),
        ("![a](u)", "[image: a]"),
    ],
)
def test_images_leave_other_characters_alone(spark, text_, want):
    assert one(spark, markdown.summarize_images(F.lit(text_))) == want


def test_code_leaves_other_characters_alone(spark):
    assert one(spark, markdown.summarize_code(F.lit("\x01```py\nx\n```\x02```\ny```$1"))) == "\x01[code: py]\x02[code: code]$1"
    assert one(spark, markdown.summarize_code(F.lit(None).cast("string"))) is None
