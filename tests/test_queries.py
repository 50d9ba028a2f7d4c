"""Every query of the catalogue against its SQL."""

import collections
import math

import duckdb
import pytest

from notelake import queries, queries_app

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_embedding_plan_skips_blank_notes_and_hits(spark):
    made = queries.embed_pipeline(spark, DATA)
    assert made.where("from_cache").count() == 0
    assert made.where("token_count is null").count() == 0
    assert made.count() == queries.globs.own_folder(queries.notes_of(spark, DATA)).count()


def test_session_documents_survive_a_round_trip(spark):
    made = queries_app.qa_document_round_trip(spark, DATA)
    q, _ = queries.quiz(spark, DATA)
    assert made.select("session_id").distinct().count() == q.select("session_id").distinct().count()
    assert made.where("user_answer is not null and (user_answer <> 'it' or explanation <> 'fine')").count() == 0
