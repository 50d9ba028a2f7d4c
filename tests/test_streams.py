"""Admission of requests, saved chat streams, mentions, numbers over a whole table, silhouettes and the layout, against loops and brute force."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.functions import json as model_json
from notelake.operators import clusters, layout, mentions, neighbours, numbering, state
from notelake.plans import providers
from notelake.streaming import events, limits, saving

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def loop(log, window, most):
    """Every request in the order of time: refused ones take no slot."""
    out, taken = {}, collections.defaultdict(list)
    for t, i, k in sorted((t, i, k) for k, i, t in log if t is not None):
        taken[k] = [x for x in taken[k] if x > t - dt.timedelta(seconds=window)]
        n = len(taken[k])
        wait = 0.0 if n < most else (taken[k][0] + dt.timedelta(seconds=window) - t).total_seconds()
        out[i] = (n, n < most, wait)
        if n < most:
            taken[k].append(t)
    return out


def request_log():
    r = random.Random(4)
    log = [("a" if i % 3 else "b", i, at(r.choice([r.uniform(0, 90), r.randint(0, 90)]))) for i in range(160)]
    return log + [("a", 900, at(30)), ("a", 901, at(30)), ("a", 902, None), (None, 903, at(1)), (None, 904, at(1.5))]


def test_admission_of_a_log(spark):
    log = request_log()
    df = spark.createDataFrame(log, "user string, request bigint, ts timestamp").repartition(5)
    got = {r.request: (r.in_window, r.allowed, r.wait_seconds) for r in limits.admitted(df, "user", "request", "ts", 20, 4).collect()}
    want = loop([(k or "", i, t) for k, i, t in log], 20, 4)
    assert {i: (n, a, round(w, 6)) for i, (n, a, w) in got.items()} == {i: (n, a, round(w, 6)) for i, (n, a, w) in want.items()}
    assert limits.admitted(df.where("false"), "user", "request").count() == 0
    # refused requests do not count: after a burst the first free moment is when the oldest admitted one leaves
    burst = [("u", i, at(i)) for i in range(12)] + [("u", 50, at(60)), ("u", 51, at(60.5))]
    told = {r.request: r.allowed for r in limits.admitted(spark.createDataFrame(burst, "user string, request bigint, ts timestamp"), "user", "request").collect()}
    assert [told[i] for i in range(12)] == [True] * 10 + [False] * 2 and told[50] and not told[51]


def test_admission_of_a_stream(spark, tmp_path):
    log = [x for x in request_log() if x[2] is not None and x[0] is not None]
    random.Random(1).shuffle(log)
    log.sort(key=lambda x: x[2] + dt.timedelta(seconds=random.Random(x[1]).uniform(0, 15)))  # out of order by less than the watermark
    end = [("z", 5000, at(4000))]
    for n, part in enumerate([log[:60], log[60:120], log[120:], end, [("z", 5001, at(8000)), ("a", 5002, at(2))]]):  # the last one comes too late
        spark.createDataFrame(part, "user string, request bigint, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("user string, request bigint, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = limits.admitted_stream(stream, "user", "request", "ts", 20, 4, "20 seconds")
        q = out.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
        q.stop()
        got = {r.request: (r.in_window, r.allowed, round(r.wait_seconds, 6)) for r in spark.table("decided").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    want = {i: (n, a, round(w, 6)) for i, (n, a, w) in loop(log, 20, 4).items()}
    assert {i: v for i, v in got.items() if i < 5000} == want
    assert 5002 not in got


def test_limiter_waits_for_a_slot():
    now, naps = [0.0], []
    slots = limits.Limiter(2, 10, lambda: now[0], lambda s: (naps.append(round(s, 6)), now.__setitem__(0, now[0] + s)))
    assert [slots.wait() for _ in range(2)] == [0.0, 0.0]
    now[0] = 4.0
    assert slots.wait() == pytest.approx(6.0) and naps == [6.0]
    assert slots.wait() == pytest.approx(0.0)
    assert slots.wait() == pytest.approx(10.0)


def test_chat_is_limited(spark):
    import time

    class Slow:
        def chat(self, messages):
            return messages[-1]["content"]

    asked = spark.range(6).select(F.col("id").alias("k"), F.lit("s").alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    began = time.time()
    assert sorted((r.k, r.response) for r in providers.chat(asked, Slow(), "k", most=3, seconds=1.5).collect()) == [(i, str(i)) for i in range(6)]
    assert time.time() - began >= 1.4
    with pytest.raises(ValueError):
        providers.chat(asked, Slow(), "k", most=1, tasks=2)


# --- saved streams ---


def tables(spark):
    c = spark.createDataFrame([("c1", "g", "New Discussion", at(0)), ("c2", "g", "Own topic", at(0)), ("c3", "g", "New Discussion", at(0)), ("c4", "h", "New Discussion", at(0))], "conversation_id string, goal_id string, topic string, created_at timestamp")
    m = spark.createDataFrame([("c1", 0, "system", "be kind", None, at(0)), ("c2", 0, "user", "hello", None, at(0)), ("c2", 1, "assistant", "yes", ["a.md"], at(1))], "conversation_id string, seq bigint, role string, content string, sources array<string>, timestamp timestamp")
    return c, m


EXCHANGES = [("e1", "c1", "first question", "one", ["x.md"], at(10)), ("e2", "c1", "second", "two", None, at(20)), ("e3", "c2", "more", "three", [], at(15)), ("e4", "c3", "third " * 20, "four", None, at(5)), ("e5", "gone", "q", "a", None, at(1))]
SCHEMA = "exchange_id string, conversation_id string, question string, content string, sources array<string>, timestamp timestamp"


def told(c, m):
    return sorted((r.conversation_id, r.goal_id, r.topic) for r in c.collect()), sorted((r.conversation_id, r.seq, r.role, r.content, tuple(r.sources or ())) for r in m.collect())


@pytest.mark.parametrize("epochs", [[[0, 1], [2, 3, 4]], [[3, 1, 4], [3, 1, 4], [2, 0], [1, 2]]])
def test_epochs_replayed_and_reordered(spark, tmp_path, epochs):
    c, m = tables(spark)
    want_c, want_m = c, m
    for e in sorted(EXCHANGES[:4], key=lambda e: e[5]):
        want_c, want_m = state.save_exchanges(want_c, want_m, spark.createDataFrame([e], SCHEMA))
    store = saving.ConversationStore(spark, str(tmp_path), 3)
    store.create(c, m)
    for n, part in enumerate(epochs):
        assert store.save(spark.createDataFrame([EXCHANGES[i] for i in part], SCHEMA), n)
    assert not store.save(spark.createDataFrame(EXCHANGES[:1], SCHEMA), 0)  # in the ledger
    # an epoch whose tables were written and whose ledger was not
    assert store.save(spark.createDataFrame([EXCHANGES[i] for i in epochs[-1]], SCHEMA), 77)
    assert told(store.conversations(), store.messages()) == told(want_c, want_m)


def test_a_stream_saves_itself(spark, tmp_path):
    c, m = tables(spark)
    store = saving.ConversationStore(spark, f"{tmp_path}/store", 2)
    store.create(c, m)
    line = lambda t: 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"%s"}}' % t
    stop = 'data: {"type":"message_stop"}'
    parts = [[("e1", 0, line("on")), ("e4", 1, line("r")), ("e2", 0, line("lost"))], [("e1", 1, line("e")), ("e1", 2, stop), ("e4", 0, line("fou"))], [("e4", 2, stop), ("e2", 1, line("never ended"))]]
    for n, p in enumerate(parts):
        spark.createDataFrame(p, "stream_id string, seq bigint, line string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    rows = spark.readStream.schema("stream_id string, seq bigint, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    questions = spark.createDataFrame([(e[0], e[1], e[2], e[4], e[5]) for e in EXCHANGES], "stream_id string, conversation_id string, question string, sources array<string>, timestamp timestamp")
    q = events.fold_stream(rows).writeStream.outputMode("update").foreachBatch(store.saver(questions)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    q.stop()
    said = {(r.conversation_id, r.seq): r.content for r in store.messages().where("role = 'assistant'").collect()}
    assert said == {("c1", 2): "one", ("c3", 1): "four", ("c2", 1): "yes"}
    assert {r.topic for r in store.conversations().collect()} == {"first question", "Own topic", "New Discussion", (("third " * 20)[:47]).rstrip() + "..."} or store.conversations().where("topic = 'first question'").count() == 1


# --- mentions, sources, numbers ---


def test_mentions_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(mentions, "BLOCK", 3)
    monkeypatch.setattr(mentions, "PART", 2500)
    notes = [("g", p) for p in ("a/Deep Work.md", "b/deep.md", "Work.md", "x/.md", "y/ÉTÉ.md", "deep/w.txt", "c/aa.md", "c/aaa.md", "b/deep.md")] + [("h", "lone.md"), (None, "n.md"), ("g", None)] + [("g", f"many/note{i:05d}.md") for i in range(50)]
    answers = [(1, "g", "On DEEP WORK and été."), (2, "g", "see a/Deep Work.md, b/deep.md"), (3, "g", "aaaa"), (4, "h", "Lone wolf"), (5, "g", ""), (6, "g", None), (7, None, "n"), (8, "zz", "deep"), (1, "g", "NOTE00017 note00018.md"), (9, "g", "w.txt only")]
    got = sorted((r.answer_id, r.path) for r in mentions.mentions(spark.createDataFrame(answers, "answer_id bigint, key string, text string"), spark.createDataFrame(notes, "key string, path string"), "key").collect())
    want = sorted({(a, p) for a, k, t in answers if t is not None and k is not None for g, p in notes if g == k and p is not None and (p in t or p.split("/")[-1].replace(".md", "").lower() in t.lower())})
    assert got == want and len(want) > 15


def test_mentions_among_very_many_notes(spark):
    notes = spark.range(100_000).select(F.lit(1).alias("goal"), F.concat(F.lit("lib/topic-"), F.lpad("id", 6, "0"), F.lit(".md")).alias("path"))
    answers = spark.range(300).select("id", F.lit(1).alias("goal"), F.concat(F.lit("As TOPIC-"), F.lpad(F.col("id") * 331, 6, "0"), F.lit(" says ")).alias("text")).withColumnRenamed("id", "answer_id")
    got = mentions.mentions(answers, notes, "goal")
    assert sorted((r.answer_id, r.path) for r in got.collect()) == [(i, f"lib/topic-{i * 331:06d}.md") for i in range(300)]


def test_sources_by_suffix(spark):
    paths = ["notes/a.md", "a.md", "b/notes/a.md", "été.md", "x/c.md"]
    wanted = ["a.md", "notes/a.md", "/notes/a.md", "md", "té.md", "none.md", "longer/than/any/of/them/x/c.md", ""]
    asked = spark.createDataFrame([(w,) for w in wanted * 2] + [(None,)], "sourceNotePath string")
    got = {r.sourceNotePath: r.source for r in model_json.source_paths(asked, spark.createDataFrame([*enumerate(paths), (9, None)], "place int, path string")).collect()}
    want = {w: next((p for p in paths if p.endswith(w)), None) for w in wanted if w}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_batches_over_the_whole_input(spark, tmp_path):
    class Counting:
        """Writes a file for each call, so that calls of all workers count."""

        batch_size = 7

        def __init__(self, folder):
            self.folder = folder

        def embed(self, texts):
            import uuid

            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            return [([float(len(t))], None) for t in texts]

    rows = spark.range(100).repartition(6).select(F.col("id").cast("string").alias("path"), F.lit("h").alias("content_hash"), F.when(F.col("id") % 10 == 0, " ").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(1).alias("estimated_tokens"))
    assert providers.embed(rows, Counting(str(tmp_path))).write.format("noop").mode("overwrite").save() is None
    sizes = sorted(int(p.read_text()) for p in tmp_path.iterdir())
    assert len(sizes) == -(-90 // 7) and sum(sizes) == 90 and sizes[1:] == [7] * 12
    assert providers.embed(rows.where("false"), Counting(str(tmp_path))).count() == 0


def test_numbers(spark):
    rows = spark.range(1000).repartition(7)
    got = numbering.numbered(rows, "n", ["id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == list(range(1000)) and sorted(r.n for r in got) == list(range(1000))
    assert numbering.numbered(rows.where("false")).count() == 0


def test_silhouette_equals_all_pairs(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    cluster = [i % 4 for i in range(59)] + [9]
    df = spark.createDataFrame([(int(c), i, v.tolist()) for i, (c, v) in enumerate(zip(cluster, x, strict=True))], "cluster int, id int, embedding array<double>")
    got = {r.id: r.silhouette for r in clusters.silhouette(df).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(60):
        mean = {c: np.mean([d[i, j] for j in range(60) if cluster[j] == c and j != i]) for c in set(cluster) if [j for j in range(60) if cluster[j] == c and j != i]}
        a, b = mean.get(cluster[i]), min(v for c, v in mean.items() if c != cluster[i])
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)
    assert {r.silhouette for r in clusters.silhouette(df.where("cluster = 1")).collect()} == {0.0}


# --- the layout ---


def test_curve_and_memberships():
    a, b = layout.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=2e-3), pytest.approx(0.895, abs=2e-3))
    d = np.sort(np.random.default_rng(1).uniform(0.1, 2, (5, 15)), 1)
    w = layout.memberships(d)
    assert np.allclose(w.sum(1), np.log2(16), atol=1e-6) and (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()


def trust(x, y, k=12):
    n = len(x)
    dx, dy = (((v[:, None] - v[None]) ** 2).sum(2) for v in (x, y))
    np.fill_diagonal(dx, -1)
    np.fill_diagonal(dy, -1)
    rank, near = dx.argsort(1).argsort(1), dy.argsort(1)[:, 1 : k + 1]
    return 1 - sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i]) * 2 / (n * k * (2 * n - 3 * k - 1))


def test_layout_keeps_neighbourhoods(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    odd = spark.createDataFrame([(90001, None), (90002, [0.0] * 64), (90003, [float("nan")] * 64)], "id bigint, embedding array<float>")
    drawn = {r.id: r.y for r in layout.reduced(e.unionAll(odd), 10, rounds=12).collect()}
    assert all(drawn.pop(i) is None for i in (90001, 90002, 90003))
    rows = e.orderBy("id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([drawn[r.id] for r in rows])
    centred = x - x.mean(0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:10].T
    assert trust(x, y) > trust(x, pca)
    nodes, cells = neighbours.placed(neighbours.unit(spark.createDataFrame([(r.id, v.tolist()) for r, v in zip(rows[:60], x[:60], strict=True)], "id bigint, embedding array<double>")))
    flat, fc = neighbours.placed(neighbours.unit(spark.createDataFrame([(r.id, v.tolist()) for r, v in zip(rows[:60], y[:60], strict=True)], "id bigint, embedding array<double>")))
    got = layout.trustworthiness(neighbours.neighbours(nodes, cells, 59), neighbours.neighbours(flat, fc, 59), 60, 8).first()[0]
    assert got == pytest.approx(trust(x[:60], y[:60], 8), abs=1e-9)


def test_layout_repeats(spark):
    e = spark.range(40).select("id", F.array(*[F.sin((F.col("id") + 1) * (i + 1)) for i in range(5)]).alias("embedding"))
    one, two = ({r.id: tuple(r.y) for r in layout.reduced(e.repartition(n), 2, 5, rounds=3).collect()} for n in (1, 5))
    assert all(np.allclose(one[i], two[i], atol=1e-6) for i in one)
    assert layout.reduced(e.where("false")).count() == 0


# --- progress, completion, prompts ---


def test_progress_while_tasks_run(spark):
    from notelake.plans import relevance

    class Slow:
        batch_size = 5

        def embed(self, texts):
            import time

            time.sleep(0.4)
            return [([1.0, 0.0], None) for _ in texts]

    notes = spark.range(60).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("content"))
    empty = spark.createDataFrame([], "path string, content_hash string, embedding array<float>")
    heard = []
    made = relevance.embedded(notes, empty, Slow(), lambda *x: heard.append(x), live=True)
    assert made.count() == 60
    counts = [n for phase, n, total, _ in heard if phase == "indexing" and total == 60]
    assert counts[0] == 0 and counts[-1] == 60 and counts == sorted(counts) and any(0 < n < 60 for n in counts)


def test_finished_goals_and_deleted_sessions(spark):
    goals = spark.createDataFrame([(1, "active", None), (2, "active", None)], "goal_id int, status string, updated_at string")
    stones = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "c", False), (None, "d", None)], "goal_id int, milestone_id string, completed boolean")
    g, m = state.finish_goals(goals, stones, spark.createDataFrame([(1,), (1,), (9,)], "goal_id int"), F.lit("now"))
    assert sorted(map(tuple, g.collect())) == [(1, "completed", "now"), (2, "active", None)]
    assert {r.milestone_id: r.completed for r in m.collect()} == {"a": True, "b": True, "c": False, "d": None}
    tables_ = [spark.createDataFrame([("s1", i), ("s2", i), (None, i)], "session_id string, x int") for i in range(3)]
    assert [sorted(map(tuple, t.collect()), key=str) for t in state.delete_sessions(*tables_, spark.createDataFrame([("s1",), (None,)], "session_id string"))] == [[("s2", i), (None, i)] for i in range(3)]


def test_prompt_builders(spark):
    from notelake.plans import prompts

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    whole = one(prompts.discussion_prompt(F.lit("G"), F.lit("D"), F.array(F.lit("a"), F.lit("b")), F.lit("## n\n\ntext")))
    assert whole == prompts.SYSTEM["discuss"] + "\n\nGoal: G\n\nD\n\nMilestones:\n- a\n- b\n\nNotes:\n\n## n\n\ntext"
    assert one(prompts.discussion_prompt(F.lit("G"), F.lit(None), F.lit(None).cast("array<string>"), F.lit(""))) == prompts.SYSTEM["discuss"] + "\n\nGoal: G"
    assert one(prompts.brainstorm_prompt(F.lit("2024-05-01").cast("date"), F.array(F.lit("x"), F.lit("y")))).endswith("Today: 2024-05-01\n\nGoals so far: x; y")
    assert one(prompts.brainstorm_prompt(F.lit("2024-05-01").cast("date"), F.lit(None).cast("array<string>"))).endswith("Today: 2024-05-01")


# --- search by grams ---


def test_note_index_equals_the_scan(spark, tmp_path):
    from notelake.operators import noteindex, review

    rows = [("a.md", "Deep Work", ["#focus", "work"]), ("b.md", "deep learning", ["ml"]), ("c.md", "Über Été", None), ("d.md", None, ["deep", None]), ("e.md", "", []), ("f.md", "aaa", ["aa"]), ("g.md", "tag:work", ["x"]), (None, "deep", ["deep"])]
    kind = "path string, title string, tags array<string>"
    index = noteindex.NoteIndex(spark, f"{tmp_path}/index", 3)
    assert index.search("deep").count() == 0

    def same(notes):
        df = spark.createDataFrame([n for n in notes if n[0] is not None], kind)
        for words in ("deep", "DEEP W", "e", "ep", "eep", "work", "focus", "#focus", "aa", "aaaa", "ét", "", "zzz", "learning", "tag:work", "x"):
            got = sorted((r.path, r.title) for r in index.search(words).collect())
            assert got == sorted((r.path, r.title) for r in review.search_notes(df, words).collect()), words

    index.put(spark.createDataFrame(rows, kind))
    same(rows)
    index.put(spark.createDataFrame([("b.md", "shallow", ["deep"]), ("h.md", "Deeper", [])], kind))
    index.remove(spark.createDataFrame([("a.md",), ("zz.md",)], "path string"))
    same([r for r in rows if r[0] not in ("a.md", "b.md")] + [("b.md", "shallow", ["deep"]), ("h.md", "Deeper", [])])
