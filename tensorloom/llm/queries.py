"""The queries of the corpus operators, by name; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, pii, secrets, urlmodel
from .backoff import score_documents
from .bpe import bpe_round_trip
from .decontaminate import find_leaks
from .langid import fit, held_out, identify
from .minhash import near_duplicates
from .spans import count_of, spelled
from .tables import table
from .winnow import compare_edited


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(spelled(base, pii.KINDS), 256).alias("base_sha256"),
        spelled(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model score of every document."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, vocab, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("bpe.token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe.token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.train()).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlmodel.judge(pages, urlmodel.fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each content scanned once."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        count_of(spans, 0).alias("n_assign"),
        count_of(spans, 1).alias("n_access"),
        count_of(spans, 2).alias("n_hex"),
        F.sha2(spelled(base, secrets.KINDS), 256).alias("base_sha256"),
        spelled(spans, secrets.KINDS).alias("spans"),
    )


def _duck_spans(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """DuckDB: the places of all matches, from the lengths of matches and gaps."""
    pattern = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {order} AS ord, '{kind}' AS kind, s, s + length(m[i]) AS e
        FROM (
            SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i,
                   list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
            FROM (
                SELECT doc_id, regexp_extract_all(body, '{pattern}') AS m, regexp_split_to_array(body, '{pattern}') AS g FROM docs
            )
        )
        WHERE {keep}"""


_ASSIGN_SQL = secrets.ASSIGN.replace("'", "''")
OP8_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS (
    {_duck_spans("assign", 0, secrets.ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN_SQL}', 1)) >= 8")}
    UNION ALL {_duck_spans("access", 1, "AKIA[A-Z0-9]{12,}")}
    UNION ALL {_duck_spans("hex", 2, "[0-9a-f]{32,}")}
    {"".join(f" UNION ALL {_duck_spans(k, secrets.KINDS.index(k), p)}" for k, (p, _) in secrets.EXTRA.items())}
),
each AS (
    SELECT doc_id,
           count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN each USING (doc_id)
"""


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or in other words."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.drop("lang"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_backoff": op2_backoff,
    "op3_bpe": op3_bpe,
    "op4_winnowing": op4_winnowing,
    "op5_main_text": op5_main_text,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_urls": op7_urls,
    "op8_secrets": op8_secrets,
    "op9_leaks": op9_leaks,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {"op8_secrets": OP8_SQL}
