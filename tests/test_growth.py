"""What has to stay cheap as tables grow: nothing worked out twice, the same results by the faster ways."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from notelake.functions import scores, text
from notelake.operators import documents, rollups, search, state


def test_documents_are_parsed_and_written_once(spark, capsys):
    rows = spark.range(3).select(F.struct(F.col("id").cast("string").alias("id")).alias("f"))
    saved = rows.select(documents.save(F.col("f"), F.lit("body")).alias("content"))
    loaded = documents.accepted(documents.load(saved, documents.CONVERSATION)).select("fields.id", "body", "content")
    loaded.explain()
    plan = capsys.readouterr().out
    assert plan.count("EvalPython [yaml_to_json") == 1 and plan.count("EvalPython [json_to_yaml") == 1
    assert sorted(tuple(r)[:2] for r in loaded.collect()) == [("0", "body"), ("1", "body"), ("2", "body")]


def test_a_document_begins_behind_its_first_front_matter(spark):
    texts = ["---\n\na: 1\n--- \n\nb\n---\nc", "---\na: 1\n---\n", "---\n---\nb", " ---\na: 1\n---\nb", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", documents.split_document(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p and tuple(r.p) for r in rows] == [("a: 1", "b\n---\nc"), ("a: 1", ""), None, None, None]


def test_texts_are_read_as_by_their_patterns(spark):
    kept = ["a  b", " a\n\n b﻿", " \t", "", None, "é  ü", "x" * 1499 + " y  z", "𝒳" * 1001 + " tail " + "𝒴" * 700, "한국어 abc 你好 カナ", " 　"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(kept)], "i int, t string")
    cjk, astral = F.regexp_count("t", F.lit(text.CJK)), F.regexp_count("t", F.lit(text.ASTRAL))
    flat = F.regexp_replace(F.regexp_replace("t", rf"{text.WS}+", " "), r"\A +| +\z", "")
    got = rows.select("i", "t", text.trim(F.col("t")).alias("a"), F.regexp_replace("t", rf"\A{text.WS}+|{text.WS}+\z", "").alias("b"), text.estimate_tokens(F.col("t")).alias("n"), F.coalesce(F.floor((2 * (F.length("t") + astral - cjk) + 2) / 3) + cjk, F.lit(0)).alias("m"), text.content_hash(F.col("t")).alias("h"), flat.alias("f")).collect()
    for r in got:
        assert r.a == r.b and r.n == r.m
        if r.t is None:
            assert r.h is None
            continue
        u = r.f.encode("utf-16-le")
        n = len(u) // 2
        h = 5381
        for x in memoryview(u if n <= 1500 else u[:2000] + u[-1000:]).cast("H").tolist() + list(map(ord, f":{n}")):
            h = (h * 33 + x) & 0xFFFFFFFF
        assert r.h == f"{h:08x}"


def test_only_the_ends_of_a_text_go_to_the_hash(spark, capsys):
    """What leaves the JVM for a hash is a sample, so a batch of long texts stays small."""
    spark.createDataFrame([("a",)], "t string").select(text.content_hash(F.col("t"))).explain()
    plan = capsys.readouterr().out
    assert "struct(ends" in plan


def test_similarities_are_worked_out_in_blocks_with_the_same_bits(spark, capsys):
    rows = [(i, i % 3, [((i * 37 + j * 11) % 101 - 50) / 7 for j in range(9)]) for i in range(90)] + [(90 + i, 1, [1.0, None, *[0.0] * 7]) for i in range(2)]
    v = spark.createDataFrame(rows + [(100 + i, label, e) for i, label, e in rows[:9]], "vec_id int, label int, embedding array<float>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = v.crossJoin(q).withColumn("similarity", scores.dot(F.col("embedding"), F.col("query")))
    got = search.similarities(v, q)
    assert sorted(map(repr, got.select("query_id", "vec_id", "similarity").collect())) == sorted(map(repr, pairs.select("query_id", "vec_id", "similarity").collect()))
    rank = F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("similarity"), "vec_id"))
    want = pairs.withColumn("rank", rank).where("rank <= 2").select("query_id", "label", "vec_id", "rank")
    assert sorted(search.top_k_each(v, q, 2, ["label"]).select("query_id", "label", "vec_id", "rank").collect()) == sorted(want.collect())
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_long_words_are_learned_once():
    """With more than 200,000 new words between two uses of a word of three tokens and more, it used to be tokenised again."""
    from itertools import islice, product

    from notelake.llm import packing

    codec, learned = packing.Ids(packing.default_tokenizer()), []
    texts = [" ".join(["", *("".join(c) for c in islice(product("qzxvkj", repeat=7), a, a + 60_000))]) for a in range(0, 240_000, 60_000)]
    first = [codec.encode([x])[0] for x in texts]
    learn = codec._learn
    codec._learn = lambda words: (learned.extend(words), learn(words))
    assert [codec.encode([x])[0] for x in texts] == first
    assert not learned


def quiz_tables(spark):
    """Questions, answers and submissions with repeats, null keys, answers without a verdict and keys that only some of the tables hold."""
    draw = random.Random(5)
    key = lambda: (draw.choice(["a", "b", "c", "d", "e", None]), draw.choice([0, 1, 2, 3, None]))
    verdict = lambda: draw.choice([True, False, None])
    q = [key() for _ in range(14)] + [("f", 0), ("f", 1), ("f", 1), ("g", 0)]
    a = [(*key(), verdict()) for _ in range(9)] + [("f", 0, True)]
    s = [(*key(), verdict(), "x") for _ in range(9)] + [("f", 1, False, "no"), ("f", 1, True, "yes"), ("f", 1, None, "none"), ("f", 0, False, "late"), ("g", 9, True, "unknown")]
    frames = spark.createDataFrame(q, "session_id string, question_id int"), spark.createDataFrame(a, "session_id string, question_id int, is_correct boolean"), spark.createDataFrame(s, "session_id string, question_id int, is_correct boolean, note string")
    return (q, a, s), frames


def test_sessions_are_scored_in_one_pass_with_the_same_results(spark, capsys):
    (q, a, s), (questions, answers, submitted) = quiz_tables(spark)
    rank = {True: 1, False: 0, None: -1}
    best = lambda rows: {k: max(rank[r[2]] for r in rows if r[:2] == k) for k in {r[:2] for r in rows if None not in r[:2]}}
    had, new = best(a), {k: v for k, v in best(s).items() if k in q and k not in best(a)}

    def scored(marks):
        out = {}
        for session in {k[0] for k in q}:
            m = [marks.get(k, -1) for k in q if k[0] == session]
            out[session] = (len(m), sum(x >= 0 for x in m), m.count(1), math.floor(m.count(1) * 100 / len(m) + 0.5))
        return out

    rows = lambda df: {r.session_id: (r.total, r.answered, r.correct, r.score) for r in df.collect()}
    assert rows(rollups.quiz_scores(questions, answers)) == scored(had)
    assert rows(rollups.quiz_scores(questions, answers, submitted)) == scored(had | new)
    sessions = spark.createDataFrame([(x, None, None) for x in ("a", "b", "c", "d", "e", "f", "g", None)], "session_id string, completed_at string, score bigint")
    done, every = state.submit_answers(sessions, questions, answers.withColumn("note", F.lit("old")), submitted, F.lit("now"))
    want = {k: v[3] for k, v in scored(had | new).items() if k is not None and v[0] == v[1]}
    assert {r.session_id: r.score for r in done.collect() if r.completed_at} == want and want["f"] == 100
    made = [r for r in every.collect() if r.note != "old"]
    assert {(r.session_id, r.question_id): rank[r.is_correct] for r in made} == new and len(made) == len(new)
    assert [r.note for r in made if r.session_id == "f"] == ["yes"] and every.count() == len(a) + len(new)
    capsys.readouterr()
    done.select("*").explain()
    assert capsys.readouterr().out.count("Join") == 1  # that with the sessions
    every.select("*").explain()
    assert "Join" not in capsys.readouterr().out


def test_grouping_by_question_stays_dealt_out(spark):
    """Adaptive execution would merge these few rows, and up to 64 MB of compressed keys, into one task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = spark.range(4000).select((F.col("id") % 900).alias("session_id"), F.col("id").alias("question_id"))
    a = q.withColumn("is_correct", F.lit(True))
    for made in (rollups.quiz_scores(q, a), rollups.new_answers(a, a.limit(9))):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == n
