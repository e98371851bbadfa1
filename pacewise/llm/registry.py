"""Queries of the training-data operators: ``queries()`` and ``oracle_sql()`` for ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddup, htmltext, langid, lmscore, ngramjoin, packing, tokencount, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.duplicates(_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_lm_scoring, op4_language_id, op5_embedding_near_dedup, op6_benchmark_decontamination, op7_html_extraction, op8_warc, op9_best_fit_packing, op10_toxicity)}


OP1 = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') ws from documents),
g as (select distinct doc_id, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') gram from w, lateral (select unnest(range(1, len(ws) - least(5, len(ws)) + 2)) k) where len(ws) > 0),
n as (select doc_id, count(*) n from g group by doc_id),
pairs as (select a.doc_id i, b.doc_id j, count(*) c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
link as (select i, j from pairs join n ni on ni.doc_id = i join n nj on nj.doc_id = j where c >= 0.8 * (ni.n + nj.n - c) - 1e-9),
comp(id, c) using key (id) as (select doc_id, doc_id from documents union select l.j, min(p.c) from comp p join link l on l.i = p.id left join recurring.comp o on o.id = l.j where p.c < o.c group by l.j)
select d.doc_id, c.c class_id, coalesce(k.n, 0) n_links from documents d join comp c on c.id = d.doc_id left join (select i, count(*) n from link group by i) k on k.i = d.doc_id"""

OP5 = """
with recursive v as (select vec_id id, label, list_transform(embedding, lambda x: x::double) x from embeddings where label is not null and embedding is not null and list_dot_product(embedding::double[], embedding::double[]) > 0),
u as (select id, label, x, sqrt(list_dot_product(x, x)) s from v),
link as (select a.id i, b.id j from u a join u b on a.label = b.label and a.id <> b.id and list_dot_product(a.x, b.x) / (a.s * b.s) >= 0.98),
comp(id, c) using key (id) as (select vec_id, vec_id from embeddings union select l.j, min(p.c) from comp p join link l on l.i = p.id left join recurring.comp o on o.id = l.j where p.c < o.c group by l.j)
select e.vec_id, coalesce(k.n, 0) n_links, c.c component_id, c.c = e.vec_id kept from embeddings e join comp c on c.id = e.vec_id left join (select i, count(*) n from link group by i) k on k.i = e.vec_id"""

OP8 = """
with p as (select page_id, coalesce(html, '') h from pages), f as (select h, min(page_id) first from p group by h),
s as (select p.page_id, strlen(p.h) n, sha1(p.h) d, first from p join f using (h)),
b as (select page_id, n, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(d, 5 * g + 1, 5))::int >> t) & 31 as int) + 1, 1), '' order by g, -t) digest
  from s, (select unnest(range(8)) g), (select unnest([15, 10, 5, 0]) t) group by all)
select page_id, n payload_bytes, digest payload_digest, case when first = page_id then 'response' else 'revisit' end record_type, case when first <> page_id then first end refers_to from b"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are models, tokenizers or parsers, and are tested against brute force."""
    return {"op1_ngram_jaccard_join": OP1, "op5_embedding_near_dedup": OP5, "op8_warc": OP8}
