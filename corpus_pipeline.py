"""A corpus pipeline of five stages. Each reads what the one before it has written."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import mixing, near_copies, pieces, secrets, toxicity
from pairwright.llm.common import columns, fresh, remove, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. The labels beside the documents teach what is toxic."""
    model = toxicity.trained(spark, sf_dir, docs)
    (score,) = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, docs.columns, out=score).where(F.col(score) < 0.5).select(columns(docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their 5-word shingles one stays, that of the smallest id:
    SimHash links of 3 bits, verified, and blocks that reach further (see near_copies)."""
    return near_copies.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to their kinds; every document stays."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(columns(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 150 % of all words, sources weighed 3, 1, 2 and so on."""
    return mixing.take(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids: the token ids of each text; round_trip, whether they decode to it, and
    text_sha256 of what they decode to."""
    model = Path(pieces.MODEL).read_bytes()
    found = pieces.encode(docs, model, ["doc_id", "lang", "source"], check=True)
    return found.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: No SQL has learned lexicons, fingerprints or balanced sampling; tests/llm/test_pipeline.py tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder as Parquet and read again. The files of a
    stage go when the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
