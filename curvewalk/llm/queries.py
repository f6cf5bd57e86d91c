"""Queries of this package's operators over the whole driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curvewalk.llm.alignment import alignment_scores
from curvewalk.llm.counts import count_tokens
from curvewalk.llm.encoding import encoding_digests
from curvewalk.llm.mixing import mix_sources
from curvewalk.llm.packing import pack
from curvewalk.llm.personal import personal_data
from curvewalk.llm.quality import judge_quality
from curvewalk.llm.sharding import assign_shards
from curvewalk.llm.simhash import near_duplicates
from curvewalk.llm.substrings import remove_repeats
from curvewalk.llm.topk import top_k
from curvewalk.llm.toxicity import fit, score_toxicity
from curvewalk.llm.vectorcodes import encode_vectors
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, lexicon).select("doc_id", "held_out", "score", "predicted", "hits")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), budget=2048)


@query(
    """
    with rows as (select row_number() over () as uid, vec_id, embedding from embeddings
                  where embedding is not null and vec_id is not null
                    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
         parts as (select uid, vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as d from rows),
         ints as (select uid, vec_id, d, floor(256 * x)::bigint as w from parts),
         scores as (select q.uid as q, q.vec_id as query_id, c.vec_id as vec_id, c.uid as uid, sum(q.w * c.w)::bigint as score
                    from ints q join ints c on q.d = c.d and q.uid <> c.uid where q.vec_id % 50 = 0 group by all),
         ranked as (select *, row_number() over (partition by q order by score desc, vec_id, uid)::int as rank from scores)
    select query_id, rank, vec_id, score from ranked where rank <= 5
    """
)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), width=50).drop("body")


@query()
def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), distance=4, width=4)
    return found.select("doc_id", "fingerprint", "component_id")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *base, "kept", "distance", "judged_by")


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    scored = alignment_scores(documents(spark, sf_dir), left, right)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return scored.select("doc_id", *columns, "n_overlaps")


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks by plain assignment: the least (squared distance, entry) of all entries, two rounds, then once more."""
    gap = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"near{i} as (select a.r, a.p, a.x, min({gap} * {entries} + b.e) as best from parts a join book{i} b on a.p = b.p group by all)"
        )
        if i < rounds:
            steps.append(
                f"""cells{i} as (select p, best % {entries} as e, unnest(x) as c, unnest(range(len(x))) as i from near{i}),
         means{i} as (select p, e, i, sum(c)::bigint as s, count(*) as n from cells{i} group by all),
         moved{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as x from means{i} group by all),
         book{i + 1} as (select b.p, b.e, coalesce(m.x, b.x) as x from book{i} b left join moved{i} m on b.p = m.p and b.e = m.e)"""
            )
    last = f"near{rounds}"
    return f"""
    with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v,
                         row_number() over (order by vec_id nulls last, embedding) as r from embeddings
                  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
         wide as (select max(len(v)) // {parts} as w from kept),
         parts as (select r, p, list_slice(v, p * w + 1, (p + 1) * w) as x from kept, wide, range({parts}) as t(p)),
         book0 as (select p, r - 1 as e, x from parts where r <= {entries}),
         {", ".join(steps)},
         coded as (select r, string_agg(printf('%02x', best % {entries}), '' order by p) as code, sum(best // {entries})::bigint as error
                   from {last} group by r),
         sums as (select label, sum(error)::bigint as label_error from coded join kept using (r) group by label),
         whole as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
    select vec_id, code, error, label_error, codebooks_sha256
    from coded join kept using (r) join sums on kept.label is not distinct from sums.label cross join whole
    """


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@query()
def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), weights=(5, 2, 1), share=1.0, most=3)
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken", "source")
