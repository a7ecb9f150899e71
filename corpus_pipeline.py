"""A corpus pipeline of five operators; each stage reads what the one before it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.bpe import encode_decode
from loamline.llm.common import prepared, removed, shared_folder, table
from loamline.llm.jaccard import jaccard_components
from loamline.llm.mixing import mixed_rows
from loamline.llm.quality import kept_rows
from loamline.llm.queries import tokenizer
from loamline.llm.substring import substring_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the policy rejects go."""
    prepared(spark)
    return kept_rows(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, with its exact completion, by five-word shingles at a Jaccard similarity of 0.8: of each
    component the document with the least id stays, once. Rows of one id are told apart by their texts."""
    prepared(spark)
    key = F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key")
    found = jaccard_components(docs.select(key, "text"), "key")
    heads = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key, F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    same = F.col("r.key.h").eqNullSafe(F.col("h.key.h")) & F.col("r.key.doc_id").eqNullSafe(F.col("h.key.doc_id"))
    return rows.alias("r").join(heads.alias("h"), same, "left_semi").dropDuplicates(["key"]).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: texts lose the words that repeat elsewhere; a text that loses none stays as it is, and one that
    loses all goes."""
    prepared(spark)
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("rest")
    cut = substring_dedup(docs, with_text=True, carry=[rest]).where("n_removed = 0 OR n_removed < n_words")
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.char_length("kept_text")).cast("bigint")}
    return cut.select(*((own[c] if c in own else F.col(f"rest.{c}")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: rows as often as the mix takes them."""
    prepared(spark)
    return mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: a row for each row of the mix."""
    prepared(spark)
    return encode_decode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_dedup", one_of_each_group), ("substring_dedup", without_repeats), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again: doc_id, n_tokens,
    ids_sha256, decoded_sha256 for each row of the mix.

    Null texts have no words, so quality rejects them, and texts that are short, all alike or full of signs; null ids stay
    and are told apart by their texts; of rows repeated with id and text one stays; ties go to the least id. Very long texts
    go through whole. Further columns, whatever their names, are carried up to the last stage and change nothing. An empty
    table gives an empty result. A stage's folder goes when the next one has been written.
    """
    folder = shared_folder(prepared(spark))
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs


#: Components of near copies and byte-level BPE are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None
