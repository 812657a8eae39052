"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, jaccard, langid, linedup, lmscore, packing, quality, tokens, warc
from .common import table


def op1_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents"), edits=True).select("doc_id", "text", "n_lines", "n_removed")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id", 4, 2)))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id", 10, 0)
    model, words = lmscore.fit(docs.where(~held_out), "text")
    return lmscore.scores(docs, model, words).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_linedup, op2_quality, op3_jaccard, op4_warc, op5_tokens, op6_decontaminate, op7_langid, op8_packing, op9_lmscore, op10_htmltext)}

ORACLES: dict[str, str] = {
    "op3_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + least(len(w), 3) - 1), ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) p from w where len(w) > 0) t),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)),
reach as (select doc_id, doc_id c from documents union select y, c from reach join links on reach.doc_id = x)
select d.doc_id, cast(coalesce(any_value(n), 0) as bigint) n_shingles, min(c) component_id from documents d join reach r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op4_warc": """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) f from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when f is not null and f <> page_id then 'revisit' else 'response' end record_type, case when f <> page_id then f end refers_to
from p left join f using (payload_digest)""",
    "op6_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item, least(len(w), 10) n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') win from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n)),
hits as (select doc_id, p, dw.n, item from dw join iw on dw.n = iw.n and dw.win = iw.win),
words as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(p, p + n)) k from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
}
