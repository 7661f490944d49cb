"""One registered query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxmill.llm import bpe, html, langid, lm, media, mixing, quality, simhash, toxicity, warc
from fluxmill.llm.common import table
from fluxmill.llm.oracle import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.references(docs))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", found["lang_score"].alias("score"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.roundtrip(table(spark, sf_dir, "pages"))
    return chunks.where("last").selectExpr("ident AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", langid.held_out(scored["doc_id"]).alias("held_out"), scored["toxicity"].alias("score"), (scored["toxicity"] >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary_path(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "restored_sha256")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), digests=True)


# The columns of four operators that their contracts determine exactly, for the comparison with SQL.


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_langid(spark, sf_dir)
    return out.select("doc_id", "held_out", (out["lang_pred"] != langid.UND).alias("lettered"), out["score"].between(0, 1).alias("scored"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_toxicity(spark, sf_dir)
    return out.select("doc_id", "held_out", ((out["predicted"] == 1) == (out["score"] >= 0.5)).alias("agrees"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


_ALL = (op1_langid, op2_lm, op3_mixing, op4_simhash, op5_html, op6_warc, op7_toxicity, op8_quality, op9_bpe, op10_media, language_folds, mixing_targets, toxicity_folds, media_payloads)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
