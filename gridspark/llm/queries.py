"""The numbered queries on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, conversations, html, langid, licenses, packing, pii, quality, rules, runs, simhash, topk, vectors
from gridspark.llm.common import load
from gridspark.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(load(spark, folder, "documents"))
    span = F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"]))
    return found.withColumn("spans", F.array_join(span, ",")).drop("matches")


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json")).drop("ids")


@query
def op3_vector_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicate_vectors(load(spark, folder, "embeddings"))


@query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(load(spark, folder, "documents")).drop("found")


@query
def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents"))


@query
def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(load(spark, folder, "pages"))


@query
def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(load(spark, folder, "embeddings"))


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(load(spark, folder, "documents"))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(load(spark, folder, "documents"))


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(load(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_damaged(load(spark, folder, "conversations"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.planted_runs(load(spark, folder, "documents"))


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(load(spark, folder, "documents"), load(spark, folder, "labels"))


_USABLE = """
    select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
    where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0"""

ORACLES["op3_vector_near_duplicates"] = f"""
    with recursive v as (select * from ({_USABLE}) u where label is not null and list_inner_product(e, e) > 0),
    l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e)
          and a.vec_id <> b.vec_id and list_inner_product(a.e, b.e)/sqrt(list_inner_product(a.e, a.e))/sqrt(list_inner_product(b.e, b.e)) >= 0.93e0),
    r(id, seen) as (select vec_id, vec_id from v union select r.id, l.b from r join l on l.a = r.seen)
    select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.c, e.vec_id) as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
    from embeddings e left join (select a, count(*) as n from l group by a) n on n.a = e.vec_id
    left join (select id, min(seen) as c from r group by id) c on c.id = e.vec_id"""

ORACLES["op7_exact_top_k"] = f"""
    with v as (select vec_id, [floor(256e0*x) for x in e] as e from ({_USABLE}) u where vec_id is not null)
    select query_id, cast(nth as int) as rank, vec_id, score from (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as nth from (
            select q.vec_id as query_id, x.vec_id, cast(list_inner_product(q.e, x.e) as bigint) as score
            from v q join v x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id and len(q.e) = len(x.e)) s) r
    where nth <= 5"""
