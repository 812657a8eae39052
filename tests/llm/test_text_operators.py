"""Tokens, decontamination, language, quality and scoring against brute force and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm import decontaminate, langid, lmscore, quality, queries, tokens
from tests_llm_common import AWKWARD, rows_equal


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_token_counts_are_the_librarys(awkward, documents, tokenizer):
    texts = {}
    for df in (awkward, documents):
        got = tokens.token_counts(df, tokens.tokenizer_path())
        want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert texts == {}


def test_odd_words_are_the_librarys_too(tokenizer):
    words = ["Ärger.", "naïve,", "ÿ", "þorn,.", "Ωmega.", "I\u0307.", "e\u0301.", "H\u0331,", "don't.", "we'LL,", "x..", ".,", "a.b", "<|endoftext|>.", "<|ENDOFTEXT|>,", "ﬁn.", "ẞ.", "ß", "×.", "÷", "Ǆ.", "ªº", "µm.", "\u00adx", "a\u00a0b.", "Σας,", "ÀÉ", "1.", "x1,", "中文.", "é" * 300 + "."]
    for lengths in (True, False):
        c = tokens.WordCoder(tokens.tokenizer_path(), lengths=lengths)
        assert c.direct
        for text in [*words, " ".join(words)]:
            want = tokenizer.encode(text, add_special_tokens=False).ids
            got = c.count(text.encode()) if lengths else np.frombuffer(b"".join(c.ids(text.encode())), "<u4").tolist()
            assert got == (len(want) if lengths else want), text


def test_token_memory_is_bounded(tokenizer):
    c = tokens.WordCoder(tokens.tokenizer_path(), lengths=True, most_words=50, batch_bytes=40)
    text = " ".join(f"word{k % 170}x" for k in range(900)).encode()
    assert c.count(text) == len(tokenizer.encode(text.decode(), add_special_tokens=False).ids)
    assert len(c.known) <= 170
    assert b" ".join(tokens.segments(text, 100)) == text


def test_tokens_of_nothing(no_rows):
    assert tokens.token_counts(no_rows, tokens.tokenizer_path()).count() == 0


def brute_hits(text, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = word(text), set(), set()
    for item, t in items:
        w = word(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most_bytes", [64 << 20, 40])
def test_decontamination_is_brute_force(spark, awkward, most_bytes):
    bench = spark.createDataFrame([(1, "TWO three, four five six seven eight nine ten eleven twelve"), (2, "drei  vier"), (3, None), (4, "..."), (11, "zwei ein"), (2, "drei  vier"), (20, "中文")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(awkward, bench, most_bytes=most_bytes).collect())
    items = sorted({(r.item_id, r.text) for r in bench.collect()}, key=str)
    want = []
    for r in AWKWARD:
        if r[0] in (7, 8):
            n, hit, found = len((r[1] or "").split()), 0, []
        else:
            n, hit, found = brute_hits(r[1], items)
        want.append((r[0] or -1, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)


@pytest.mark.parametrize("most_bytes", [64 << 20, 20])
def test_items_without_an_id_are_hits_as_in_the_sql(spark, tmp_path, most_bytes):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, "beta gamma"), (3, "delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (7, "beta gamma"), (12, None)], "item_id long, text string")
    got = decontaminate.contamination(docs, bench, most_bytes=most_bytes).drop("spans").toPandas()
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rows_equal(got, con.execute(queries.ORACLES["op6_decontaminate"]).df())
    assert got.set_index("doc_id").n_items.to_dict() == {1: 2, 2: 1, 3: 0}


def test_decontamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Äh -- Alpha, BETA! gamma; und")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).first()
    assert [docs.first().text[s.a : s.b] for s in r.spans] == ["Alpha, BETA! gamma"]
    assert decontaminate.contamination(docs, bench.where("false")).first().n_hit == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows_equal(queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_language_of_unseen_documents(spark, sf, documents):
    got = queries.op7_langid(spark, sf)
    r = got.join(documents.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 20 and r.right > 0.97
    assert got.where("score < 0 or score > 1").isEmpty()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.collect())


def test_language_backs_off_and_gives_up(spark, awkward, no_rows, documents):
    model = langid.fit(documents)
    by_id = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1, 2, 3, 4))
    p = langid.Predictor(model, most=4)
    assert p.predict("queadomente ciónosado".encode())[0] == "es"  # unseen as words
    assert p.predict(" ".join(f"zu{k}ung" for k in "abcdefghij").encode())[0] == "de"
    assert langid.predict(no_rows, model).count() == 0
    assert langid.Predictor(langid.fit(no_rows)).predict(b"hello") == ("und", 0.0)
    assert {r.doc_id for r in langid.accepted(awkward, model).collect()}.isdisjoint({1, 2, 3, 4})


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_counts_are_brute_force(documents):
    for r in [*AWKWARD, *((r.doc_id, r.text) for r in documents.collect())]:
        assert quality.counts_of((r[1] or "").encode()) == brute_counts(r[1])
    assert quality.counts_of("a a a a # b c".encode())[4] == 4


def test_quality_verdicts(spark, awkward, no_rows):
    got = {r.doc_id: r for r in quality.quality(awkward).collect()}
    assert got[1].base_failed and not got[1].kept and got[7].base_failed
    assert quality.quality(no_rows).count() == 0
    good = [(k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(80)), "en", "s") for k in range(150)]
    junk = [(1000 + k, " ".join("$$$%%%" if j % 2 else f"q{k}{j}" for j in range(80)), "en", "s") for k in range(5)]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(150)) and not any(kept[1000 + k] for k in range(5))


def test_sketches_merge_to_the_same_quantiles(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.rand(3).alias("x"))
    whole = df.agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("x", F.lit(400)), F.lit(0.5)).alias("q")).first().q
    parts = df.groupBy("g").agg(F.kll_sketch_agg_double("x", F.lit(400)).alias("s")).agg(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("s", F.lit(400)), F.lit(0.5)).alias("q")).first().q
    assert abs(whole - 0.5) < 0.03 and abs(parts - 0.5) < 0.03


def test_scores(spark, documents, awkward, no_rows):
    train = documents.where("crc32(cast(doc_id as string)) % 10 <> 0")
    model, words = lmscore.fit(train, "text")
    both = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    held = both.withColumn("k", F.concat_ws(":", "doc_id", F.xxhash64("text"))).drop("doc_id").withColumnRenamed("k", "doc_id")
    a = lmscore.scores(held, model, words).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = lmscore.scores(held, model, words, most_words=1).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert np.allclose(a[["base_score", "score"]], b[["base_score", "score"]], atol=1e-6) and (a[["n_tokens", "n_known"]] == b[["n_tokens", "n_known"]]).all().all()
    counts = Counter()
    for r in train.collect():
        counts.update((r.text or "").encode().lower().split() + [b" "])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lmscore.scores(awkward, model, words).collect()}
    for doc, text, *_ in AWKWARD:
        t = (text or "").encode().lower().split() + [b" "]
        assert got[doc].n_tokens == len(t) and got[doc].n_known == sum(counts[w] > 0 for w in t) and got[doc].train_tokens == n
        assert got[doc].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    assert lmscore.scores(no_rows, model, words).count() == 0
    unseen = a[a.doc_id.map(lambda k: k.split(":")[0].isdigit() and zlib.crc32(k.split(":")[0].encode()) % 10 == 0)]
    assert (unseen.score / unseen.n_tokens).mean() > (unseen.base_score / unseen.n_tokens).mean()


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    table = lmscore.train(rng.integers(0, 5, (36, 6)).astype(float), size=4, steps=20)
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-4)
    assert np.allclose((10.0 ** lmscore.train(np.zeros((36, 6)), size=4, steps=20)).sum(axis=1), 1, atol=1e-4)


def test_scores_learn_from_nothing(no_rows, awkward):
    model, words = lmscore.fit(no_rows, "text")
    assert {r.n_known for r in lmscore.scores(awkward, model, words).collect()} == {0}
