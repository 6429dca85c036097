"""The registered queries of this subpackage; ``ORACLES`` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobcast.llm import bpe, kneser_ney, language, lexical, metric_tree, pieces, sharding, simhash, spelling, suffixes, tiling, toxicity, urls
from jobcast.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 64)
    return metric_tree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLES["op1_metric_tree"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64.0 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.classify_quality(table(spark, sf_dir, "documents"), kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "lang", "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "keep")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, whole=True)


@query
def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op8_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])
    return toxicity.score_chain(docs, chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query
def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.shard_rows(rows, "doc_id", sharding.even_tree(8), sharding.even_tree(8, grown=1)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


ORACLES["op11_reversed_search"] = r"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
asked as (select row_number() over () as i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
wanted as (select i, item_id, term, count(*) as times from asked group by i, item_id, term),
sizes as (select r, doc_id, cast(len(t) as bigint) as n from words where len(t) > 0),
sums as (select count(*) as nd, cast(sum(n) as bigint) as nt from sizes),
counts as (select r, term, count(*) as tf from (select r, unnest(t) as term from words) where term in (select term from wanted) group by r, term),
weights as (select term, cast(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) as bigint) as w from counts, sums group by term, nd),
scores as (select i, item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) as bigint) as score
  from wanted join weights using (term) join counts using (term) join sizes using (r), sums group by i, item_id, r, doc_id),
ranks as (select *, cast(row_number() over (partition by i order by score desc, doc_id) as int) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranks where rank <= 10
"""


@query
def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES))
