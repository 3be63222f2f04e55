"""A corpus pipeline: language, near-duplicates, leaks, personal data, tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return
the columns of ``documents``; what a stage decides takes effect in its rows or
texts.  ``run`` writes each stage's result as Parquet in the shared folder and
reads it as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.bpe import bpe_round_trip
from tensorloom.llm.decontaminate import find_leaks
from tensorloom.llm.langid import fit, held_out, identify
from tensorloom.llm.minhash import content_id, near_duplicates
from tensorloom.llm.pii import KINDS, find_pii
from tensorloom.llm.spans import replaced
from tensorloom.llm.tables import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; it fills in a missing ``lang``."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    judged = identify(docs, model, out="__language").where(~F.col("__language.rejected"))
    return judged.withColumn("lang", F.coalesce("lang", F.col("__language.lang"))).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; one without an id only if none has one.

    A row is known by its id and its content, as ids may be missing or repeated.
    """
    found = near_duplicates(docs.select("doc_id", "text")).groupBy("class_id", "doc_id", "content").agg(F.count("*").alias("n"))
    first = found.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("__id"), F.col("content").alias("__content"), F.col("n").alias("__n"))).alias("first"))
    first = stored(first.select("first.__id", "first.__content", "first.__n"), "kept")
    kept = docs.join(first.hint("shuffle_hash"), (content_id(F.col("text")) == F.col("__content")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    if first.where("__n > 1").isEmpty():
        return kept.select(docs.columns)
    return kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__content"])).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; which do is a matter of their text, not of their id."""
    content = F.xxhash64(content_id(F.col("text")))
    leaks = find_leaks(docs.select(content.alias("__own"), "text"), table(spark, sf_dir, "benchmark"), key="__own")
    leaks = stored(leaks.select("__own").distinct(), "leaks")
    return docs.join(leaks.hint("shuffle_hash"), content == F.col("__own"), "left_anti").select(docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes a mark of its kind."""
    found = find_pii(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))
    clean = replaced(F.col("text"), F.col("spans"), [f"<{k.upper()}>" for k in KINDS])
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, 32 bits each) beside the documents' columns, and whether they decode to the text."""
    # other stages' workers stand beside these, so they hold less than the operator's own query does
    both = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out="__bpe", max_states=20_000, max_pieces=60_000)
    ids = F.col("__bpe.token_ids")
    same = F.col("__bpe.decoded") == F.coalesce("text", F.lit(""))
    return both.select(*docs.columns, ids.alias("token_ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("personal_data", without_pii),
    ("tokens", tokens),
]

#: The stages rest on trained models, sketches and merges that SQL cannot say; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
