"""The thin queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.bpe import encode_decode
from loamline.llm.common import prepared, text_of
from loamline.llm.common import table as any_table
from loamline.llm.filter_audit import ORACLE as AUDIT_SQL
from loamline.llm.filter_audit import filter_audit
from loamline.llm.forest import minhash_components
from loamline.llm.html import extract_pages
from loamline.llm.licenses import license_scan
from loamline.llm.mixing import mix_documents
from loamline.llm.quality import ORACLE as QUALITY_SQL
from loamline.llm.quality import quality
from loamline.llm.runs import digests, periodic_runs, with_repeats
from loamline.llm.simhash import simhash_components
from loamline.llm.substring import substring_dedup
from loamline.llm.token_counts import token_counts
from loamline.llm.token_files import token_files
from loamline.llm.topk import ORACLE as TOPK_SQL
from loamline.llm.topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return any_table(prepared(spark), sf_dir, name)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(periodic_runs(docs.select("doc_id", with_repeats(F.col("doc_id"), text_of()).alias("text"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_topk": op3_topk,
    "op4_simhash": op4_simhash,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_html_text": op10_html_text,
    "op11_minhash": op11_minhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {"op3_topk": TOPK_SQL, "op7_quality": QUALITY_SQL, "op13_filter_audit": AUDIT_SQL}
