"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import (byte_bpe, chat_grammar, covering_simhash, decontamination, deleted_interpolation, hyper_langid,
               license_rules, merkle_climb, oracle, prefix_trie, secret_ledger, spotsigs, toxicity_fm, warc_chunks)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.scan(docs, f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex[:12]}",
                                path_col="doc_id")
    found = secret_ledger.by_path(docs, ledger)
    kinds = ["assign", "access", "hex"]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    joined = lambda c: F.concat_ws(",", F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "blob")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_rules.recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_sentences", F.concat_ws(",", "sentence_ids").alias("sentence_ids"),
                      F.concat_ws(",", "licences").alias("licences"), F.concat_ws(",", "unmatched").alias("unmatched"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_fm.score(docs, toxicity_fm.learn(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = hyper_langid.prototypes(hyper_langid.training_rows(docs))
    rows = docs.select("doc_id", "text", hyper_langid.is_held_out().alias("held_out"))
    return hyper_langid.predict(rows, learned, ["doc_id", "held_out"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc_chunks.new_folder(spark)
    files = warc_chunks.write(pages, folder)
    got = warc_chunks.records(warc_chunks.read_chunks(files, folder))
    return got.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest",
                      F.col("type").alias("record_type"), F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the tampering: every document whose id has an even CRC loses its line ends
    cut = (F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
           .otherwise(F.col("text")))
    found = merkle_climb.climb(merkle_climb.build(merkle_climb.leaves(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", {"text": cut})), whole_proof=False)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = prefix_trie.trie(*prefix_trie.branched(table(spark, sf_dir, "conversations"), family=5, most=9))
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))],
                                 "conv_id bigint, turn bigint, role string, text string")
    return chat_grammar.read_back(chat_grammar.format_turns(rows.unionByName(both)), dealt=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_license_scans, op3_lm_scoring, op4_document_fingerprints, op5_decontamination, op6_byte_bpe,
    op7_toxicity, op8_simhash, op9_language_id, op10_warc,
    op11_merkle_manifest, op12_prefix_trie, op13_chat_formatting, pipeline)}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = oracle.ORACLES
