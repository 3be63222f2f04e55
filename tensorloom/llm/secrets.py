"""Secret scans with an incremental ledger of blobs, in SQL functions only.

Every version of a document is addressed by the SHA-256 of its content.  The
ledger, a Parquet folder, has a row for each blob and version of the rules
that was scanned, with the findings.  A scan reads the text of blobs only that
have no row for the present version, each once, however many paths hold it;
the findings are then joined back to all paths.  A second scan with the same
rules therefore scans nothing but new contents.

Hot contents are no trouble: paths are grouped by blob with a partial
aggregate, the text of one path of each blob is read, and the join back is a
plain sort-merge join, whose large partitions Spark splits.

A null text is an empty one.  Repeated paths get one row each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import as_spans, by_start, matches
from .tables import shared_dir

RULES_VERSION = 1
# fixed values: the rules of version 1; the first three are the base
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "private_key", "github", "slack", "google", "jwt"]
EXTRA = {
    "private_key": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", "PRIVATE KEY-----"),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    "google": (r"AIza[0-9A-Za-z_-]{35,}", "AIza"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "eyJ"),
}


def find_secrets(text: Column) -> Column:
    """Spans of all kinds in ``text`` (not null), sorted by start and kind.

    ``hex`` and ``access`` ask for their least length in the pattern: a run
    that is too short has no longer one inside.
    """
    lower = F.lower(text)
    words = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    assign = F.filter(matches(text, ASSIGN, words), lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 1)) >= 8)
    found = [
        as_spans(assign, 0),
        as_spans(matches(text, "AKIA[A-Z0-9]{12,}", text.contains("AKIA")), 1),
        as_spans(matches(text, "[0-9a-f]{32,}", text.rlike("[0-9a-f]{32}")), 2),
    ]
    for kind, (pattern, sign) in EXTRA.items():
        found.append(as_spans(matches(text, pattern, text.contains(sign)), KINDS.index(kind)))
    return by_start(F.concat(*found))


def read_ledger(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """Blobs that were scanned under ``version``; None where no ledger is yet."""
    try:
        return spark.read.parquet(path).where(F.col("version") == version)
    except Exception as e:  # the folder does not exist
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scan(docs: DataFrame, ledger: str | None = None, key: str = "doc_id", text: str = "text", version: int = RULES_VERSION) -> DataFrame:
    """One row for each row of ``docs``: its key, ``blob`` and ``spans``.

    ``ledger`` is a folder that driver and executors share; a new one in the
    shared folder if it is not given.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blob = F.unhex(F.sha2(body, 256))
    paths = docs.select(F.col(f"`{key}`").alias("path"), blob.alias("blob"))
    todo = paths.groupBy("blob").agg(F.min("path").alias("first_path"))
    known = read_ledger(spark, ledger, version)
    if known is not None:
        todo = todo.join(known.select("blob"), "blob", "left_anti")
    texts = docs.select(F.col(f"`{key}`").alias("path"), blob.alias("blob"), body.alias("body"))
    wanted = todo.select(F.col("blob").alias("todo_blob"), "first_path").hint("shuffle_hash")
    fresh = texts.join(wanted, (F.col("blob") == F.col("todo_blob")) & F.col("path").eqNullSafe(F.col("first_path")), "left_semi")
    findings = fresh.select("blob", F.lit(version).alias("version"), find_secrets(F.col("body")).alias("spans"))
    findings.write.mode("append").parquet(ledger)
    # repeated rows of one path are scanned together, so a blob may have equal rows
    scanned = spark.read.schema("blob binary, version int, spans array<struct<kind:int,start:int,end:int>>").parquet(ledger)
    hits = scanned.where((F.col("version") == version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    hits = stored_hits(hits, ledger)
    return paths.join(hits, "blob", "left").select(F.col("path").alias(key), "blob", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("spans"))


def stored_hits(hits: DataFrame, ledger: str) -> DataFrame:
    """Blobs with findings, written beside the ledger.

    Read from a file, they come to the join back without a partitioning of
    their own, and the join can split a hot blob.
    """
    path = f"{ledger}-hits-{uuid.uuid4().hex}"
    hits.write.parquet(path)
    return hits.sparkSession.read.schema(hits.schema).parquet(path)
