"""From raw documents to packed training sequences: quality, near-duplicates, passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written and read again as the next one's docs.
All but the last return the columns of documents. A text that a stage changes gets a new n_chars if there is that
column; a null text stays null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewalk.llm.packing import pack
from curvewalk.llm.personal import mask_text
from curvewalk.llm.quality import judge_quality
from curvewalk.llm.simhash import near_duplicates
from curvewalk.llm.substrings import remove_repeats
from curvewalk.llm.tables import body_key, free_name
from curvewalk.sources.tables import materialize, scratch, shared_folder


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that have an id and text of rows (doc_id, body)."""
    gone = rows.select(F.col("doc_id").alias("id_"), F.col("body").alias("body_")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id_"]) & (body_key() == gone["body_"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return _without(docs, judge_quality(docs).where("not kept"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by fingerprints that differ in 4 bits or fewer, of 4-word shingles, exactly one stays.

    It is the one with the smallest doc_id, null ids last, then the smallest hash of its text; of rows that repeat both,
    any one.
    """
    found = materialize(near_duplicates(docs, distance=4, width=4), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first")
    chosen = found.groupBy("group").agg(first)
    rows = found.groupBy("doc_id", "body").agg(F.first("group").alias("group"), F.count("*").alias("n"))
    gone, again, doc, body = (free_name(docs.columns, c) for c in ("gone", "again", "doc", "body"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))
    rules = rows.join(chosen, "group").select(
        F.col("doc_id").alias(doc), F.col("body").alias(body), (~stays).alias(gone), (F.col("n") > 1).alias(again)
    )
    rules = rules.where(F.col(gone) | F.col(again))
    ruled = docs.join(rules, docs["doc_id"].cast("long").eqNullSafe(rules[doc]) & (body_key() == rules[body]), "left")
    ruled = ruled.where(~F.coalesce(F.col(gone), F.lit(False)))
    once = ruled.where(F.col(again)).dropDuplicates([doc, body])
    return ruled.where(F.col(again).isNull()).unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out of the later ones."""
    others = {f"other_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    carry = {name: F.col(f"`{c}`") for name, c in others.items()} | {"no_text": F.col("text").isNull()}
    cut = remove_repeats(docs, with_text=True, carry=carry)
    back = {c: F.col(name) for name, c in others.items()}
    back["doc_id"] = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    back["text"] = F.when(~F.col("no_text"), F.col("kept_text"))
    return _with_length(cut.select(*[back[c].alias(c) for c in docs.columns]))


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the mask of its kind."""
    return _with_length(mask_text(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens in the mixture of the sources, one row per piece.

    Workers also hold what the other stages need, so they remember fewer words than packing alone would let them.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1, remembered=(100_000, 50_000))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-duplicates", near_duplicate_removal),
    ("repeated passages", passage_removal),
    ("personal data", personal_data_removal),
    ("packing", packing),
]

#: The stages can't be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one stores on its way is removed once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_folder(spark, f"stage-{number}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
