"""A training-corpus pipeline over ``documents``: each stage's result is written and read by the next.

Null and empty texts are rejected by the first stage (they have no language);
stages keep repeated rows except near-dedup, which leaves one document of each
group.  Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.llm import byte_bpe, covering_simhash, decontamination, hyper_langid, secret_ledger
from shopgauge.session import checkpoint_dir, write_and_reload

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those near to no learned language."""
    rows = hyper_langid.training_rows(docs)
    found = hyper_langid.predict(docs, hyper_langid.prototypes(rows), [*COLUMNS], hyper_langid.profiles(rows))
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 64-bit SimHashes (4-word shingles) within 4 bits."""
    return covering_simhash.keep_one(docs, shingle=4, radius=4).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, edited or not, of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each character of a found secret by ``*``; all documents stay."""
    import uuid

    folder = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex[:12]}"
    return secret_ledger.redact(docs, secret_ledger.scan(docs, folder, path_col="doc_id")).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the text's token ids, their number, and whether they decode to the text's bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")),
                          path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans),
          ("byte-level BPE encoding and decoding", bpe_encoding)]

#: SQL has neither hyperdimensional vectors nor XXH64 nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_and_reload(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name, stage = STAGES[-1]
    return write_and_reload(stage(spark, docs, sf_dir), "stage-last")
