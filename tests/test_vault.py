"""The data source of notes: what it lists, what it reads, and streams of changes."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from notelake.sources import vault


@pytest.fixture
def root(tmp_path):
    files = {"top.md": "t", "a/one.md": "# one\n", "a/b/two.md": "zwei é", "a/b/c/deep.md": "", "work/x.md": "x", "work/.obsidian/no.md": "n", "node_modules/p/no.md": "n", ".git/no.md": "n", "a/note.txt": "n", "templates/t.md": "t", "work/sub/node_modules/q/no.md": "n", "a/.hidden.md": "n", "ab/other.md": "o"}
    for name, text in files.items():
        p = tmp_path / "vault" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "vault")


NOTES = ["a/b/c/deep.md", "a/b/two.md", "a/one.md", "ab/other.md", "templates/t.md", "top.md", "work/x.md"]


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


@pytest.mark.parametrize("filters", [False, True])
def test_read_all_and_filtered(spark, root, filters):
    vault.register(spark, filters)
    try:
        df = lambda: spark.read.format("notes").option("path", root).option("filters", str(filters).lower()).load()
        assert paths(df()) == NOTES
        rows = {r.path: r for r in df().collect()}
        assert (rows["a/b/two.md"].basename, rows["a/b/two.md"].folder, rows["a/b/two.md"].content, rows["top.md"].folder) == ("two", "a/b", "zwei é", "")
        assert all(r.modified_at is not None and r.created_at is None for r in rows.values())
        assert paths(df().where(F.col("path").startswith("a/b/"))) == ["a/b/c/deep.md", "a/b/two.md"]
        assert paths(df().where("path = 'a/one.md'")) == ["a/one.md"] and paths(df().where("path in ('top.md', 'work/x.md', 'gone.md')")) == ["top.md", "work/x.md"]
        assert paths(df().where("path = 'a/one.md' and path = 'top.md'")) == [] and paths(df().where("path like 'work/.obsidian/%'")) == [] and paths(df().where("path = '.git/no.md'")) == []
        assert paths(df().where("content = 'x' or path = 'top.md'")) == ["top.md", "work/x.md"]
        with pytest.raises(Exception, match="path"):
            spark.read.format("notes").load().collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_globs_of_the_source(spark, root):
    some = vault.notes(spark, root, ["a/**", "top.md"], ["**/deep.md"])
    assert paths(some.where("path <> 'top.md'")) == ["a/b/two.md", "a/one.md"] and paths(some) == ["a/b/two.md", "a/one.md", "top.md"]


def opened(root, *filters, **options):
    reader = vault.FilteredReader(vault.Wanted(root, **options))
    list(reader.pushFilters(list(filters)))
    listing = vault.Listing(reader.wanted)
    names = [p for part in listing.partitions() for p, _ in vault.Listing.notes(listing, part)]
    return sorted(names), listing.opened


def test_only_matching_folders_are_listed(root):
    every, n = opened(root)
    assert every == NOTES and n == 1 + 1 + 7  # the root to plan and to read, then a, a/b, a/b/c, ab, templates, work, work/sub
    assert opened(root, StringStartsWith(("path",), "a/b/")) == (["a/b/c/deep.md", "a/b/two.md"], 1 + 1 + 1)
    assert opened(root, EqualTo(("path",), "work/x.md")) == (["work/x.md"], 1 + 1)
    assert opened(root, In(("path",), ("a/one.md", "work/x.md")))[0] == ["a/one.md", "work/x.md"]
    assert opened(root, EqualTo(("path",), "a/one.md"), EqualTo(("path",), "top.md"))[0] == []
    assert opened(root, EqualTo(("content",), "x"))[1] == n
    assert opened(root, include=("templates/**",)) == (["templates/t.md"], 1 + 1)


def test_new_and_changed_notes_once(spark, root, tmp_path):
    vault.register(spark)

    def run():
        stream = spark.readStream.format("notes").option("path", root).load()
        q = stream.select("path", "content").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("path", "content").collect()))

    first = run()
    assert [p for p, _ in first] == NOTES
    assert run() == first
    with open(f"{root}/a/one.md", "w") as f:
        f.write("changed")
    os.makedirs(f"{root}/new")
    with open(f"{root}/new/n.md", "w") as f:
        f.write("new")
    assert run() == sorted([*first, ("a/one.md", "changed"), ("new/n.md", "new")])
