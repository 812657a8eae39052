"""Rows that share ids, columns with the names that operators use inside, tables that go when nothing reads them, odd pages."""

import gc
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import common, decontaminate, htmltext, jaccard, linedup, lmscore, tokens


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    twice = "alpha beta gamma delta epsilon zeta\nsecond line of the text stands here"
    rows = [(1, twice), (2, twice), (2, "a line found nowhere else at all\nalpha beta gamma delta epsilon zeta"), (None, "only here without an id\n" + twice)]
    got = sorted(((r.doc_id, r.text) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=True).collect()), key=str)
    assert got == sorted([(1, twice), (2, ""), (2, "a line found nowhere else at all"), (None, "only here without an id")], key=str)


@pytest.mark.parametrize("edits", [True, False])
def test_line_dedup_leaves_other_columns_alone(spark, edits):
    names = ["__doc", "__gone", "__text", "__id", "bare", "ID_", "t1", "t2", "lost", "new", "doc", "key", "n_lines"]
    df = spark.createDataFrame([(1, "x y z\nx y z\n"), (2, "x y z")], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    out = linedup.dedup_lines(df, edits=edits)
    assert out.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r["__doc"], r.ID_) for r in out.collect())
    assert got == [(1, "x y z\n", 3, 1, "__doc", "ID_"), (2, "", 1, 1, "__doc", "ID_")]


def test_stages_take_columns_named_as_their_own(spark, sf, documents):
    df = documents.limit(60).withColumns({c: F.lit(1) for c in ("row", "row_", "__row", "sig", "block", "gone")})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.benchmark):
        out = stage(spark, df, sf)
        assert out.columns == df.columns and 0 < out.count() <= 60


def test_tables_go_once_nothing_reads_them(spark, documents):
    folder = common.shared_dir(spark).removeprefix("file://")
    linedup.dedup_lines(documents, edits=True).count()
    left = []
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        common.kept(spark.range(1), "probe")
        left = [x for x in os.listdir(folder) if x.startswith("linedup")]
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_a_long_line_without_spaces_is_found_again(spark):
    rng = np.random.default_rng(5)
    text = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 4000))
    near = text[:2000] + "一" + text[2001:]
    df = spark.createDataFrame([(1, text), (2, near), (3, text[::-1])], "doc_id long, text string")
    assert {r.doc_id for r in linedup.dedup_lines(df, edits=True).where("n_removed = 0").collect()} == {1, 3}


def test_an_open_head_ends_where_it_must():
    model = htmltext.train()
    body = "<article><h1>A title of the page</h1><p>" + "Some words of a longer story, told at length. " * 6 + "</p><p>" + "And more of them, with commas, too. " * 6 + "</p></article>"
    want = htmltext.extract([f"<html><head><title>t</title></head><body>{body}</body></html>"], model)
    assert want[0] and htmltext.extract([f"<html><head><title>t</title>{body}</html>"], model) == want
    texts = [r.text for r in htmltext.runs(htmltext.parse("<head><meta charset=utf-8><title>t</title>words <p>more</p>"))]
    assert texts == ["words", "more"]


def test_scores_are_the_models_own(spark):
    """Each token's class under the class before it, and its share of the class, by hand on a tiny corpus."""
    train = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "b a b", "c c a rare", None, ""])], "doc_id long, text string")
    model, words = lmscore.fit(train, "text", top=2, rest=3)
    counts = {lmscore.END: 5, b"a": 4, b"b": 3, b"c": 3, b"rare": 1}
    table = {r.hash: r.n for r in words.collect()}
    assert sorted(table.values()) == sorted(counts.values()) and np.allclose((10.0**model.table).sum(axis=1), 1, atol=1e-4)
    texts = ["a b", "rare new c", "", None, "A"]
    got = {r.doc_id: r for r in lmscore.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, words).collect()}
    for k, t in enumerate(texts):
        before, total = 0, 0.0
        for w in [*(t or "").lower().encode().split(), lmscore.END]:
            c = model.classes.of(w)
            total += float(model.table[before, c])
            if c >= model.classes.n - model.classes.rest:
                own = [counts[x] for x in counts if model.classes.of(x) == c]
                total += np.log10((counts.get(w, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
            before = c
        assert got[k].score == pytest.approx(total, rel=1e-5)


def test_long_words_are_forgotten():
    c = tokens.WordCoder(tokens.tokenizer_path(), lengths=True)
    long = "x" * 1000
    assert c.count(f"a {long} b".encode()) == c.count(b"a b") + c.count(long.encode())
    c.count(b"again")
    assert long.encode() not in c.known and b"again" in c.known


def test_shards_of_a_benchmark_give_what_one_gives(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start w{k}x0 " + " ".join(f"w{k}x{j}" for j in range(2, 13)) + " end") for k in range(60)], "doc_id long, text string")
    one = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    assert one == sorted(map(str, decontaminate.contamination(docs, items, most_bytes=900).collect()))


def joined_columns(df):
    """Names of the columns on either side of each join of df's plan."""
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            out += [{side.output().apply(k).name() for k in range(side.output().size())} for side in (node.left(), node.right())]
    return out


def test_no_prefix_crosses_the_join_by_block(spark, documents, monkeypatch):
    """Beyond the broadcast limit each row of a prefix would carry the whole prefix through a shuffle."""
    seen, keep = {}, jaccard.kept
    monkeypatch.setattr(jaccard, "kept", lambda df, name: (seen.setdefault(name, joined_columns(df)), keep(df, name))[1])
    monkeypatch.setattr(jaccard, "small", lambda table: table)
    assert jaccard.jaccard_components(documents).count() == documents.count()
    assert seen["jaccard-members"] and not any("prefix" in names for names in seen["jaccard-members"])
