"""The pipeline stage by stage against brute force."""

import pyarrow as pa

import corpus_pipeline
from test_operators import brute_sets, odd_documents, prose, roots


def test_stages(spark, folder):
    d = folder(documents=odd_documents())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = odd_documents().to_pydict()
    text = {i: x for i, x in zip(t["doc_id"], t["text"], strict=True) if i is not None}
    known = corpus_pipeline.language_id(spark, docs, d)
    assert known.columns == docs.columns
    rows = [r.doc_id for r in known.collect()]
    ids = {i for i in rows if i is not None}
    assert ids == {i for i, x in text.items() if x and any(c.isalpha() for c in x)} and rows.count(None) == 1 and rows.count(7) == 2
    one = corpus_pipeline.ngram_jaccard_join(spark, known, d)
    assert one.columns == docs.columns
    sets = {i: brute_sets(text[i]) for i in ids}
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    rows = [r.doc_id for r in one.collect()]
    assert sorted(i for i in rows if i is not None) == sorted(i for i in ids if want[i] == i) and rows.count(None) == 1  # one row of each, of repeated rows too
    cut = corpus_pipeline.suffix_dedup(spark, one, d)
    left = {(r.doc_id, r.text) for r in cut.collect()}
    assert cut.columns == docs.columns and left == {(r.doc_id, r.text) for r in one.collect()}  # near copies are gone, and no passage of 50 words is left twice
    packed = corpus_pipeline.best_fit_packing(spark, cut, d).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left}


def test_passages_are_cut_once(spark, folder):
    """Documents apart but for a passage of 60 words: the first keeps it, the others lose it, as brute force says."""
    passage = prose(50, 60)
    texts = {i: f"{prose(60 + i, 300)} {passage} {prose(80 + i, 200)}" for i in range(4)} | {9: prose(99, 400)}
    d = folder(documents=odd_documents().slice(0, 0))
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, corpus_pipeline.ngram_jaccard_join(spark, df, d), d).collect()}
    assert got == {i: x if i in (0, 9) else x.replace(passage + " ", "") for i, x in texts.items()}


def test_empty_table(spark, folder):
    empty = odd_documents().slice(0, 0)
    d = folder(documents=empty.cast(empty.schema.set(3, pa.field("source", pa.string()))))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
