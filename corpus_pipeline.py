"""From raw documents to packed training sequences.

Each stage takes what the one before has kept, is written as Parquet and read again.
All but the last return the columns of ``documents``:

quality          rejects documents that the classifier, fitted on the labels, scores below 0.5
near_duplicates  keeps one document of each group of near-equal ones, the smallest id
pii              puts the kind in place of every personal-data span
mixing           takes each source up to its target, in training order; a document taken more
                 than once is that many rows, the last one of a source may be cut at a word
packing          packs the ids of what is left into sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import mixing, ngramjoin, packing, pii
from quirefold.llm import quality as classifier
from quirefold.llm.common import BATCH_ROWS, TEXT_ROWS, free_name, table
from quirefold.session import materialize

#: Dropped ids up to this number are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stages run when they are written, so the smaller Arrow batches hold for the session from here on
    spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    weights = classifier.train(docs, table(spark, sf_dir, "labels"), classifier.may_learn(F.col("doc_id")))
    score = free_name(docs, "score")
    return classifier.score(docs, weights, score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null id stay; rows that repeat an id and its text become one."""
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    groups = materialize(ngramjoin.ngram_join(docs))
    kept = groups.where("component_id = doc_id").select("doc_id")
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    uses = mixing.training_order(mixing.mix(docs, keep=docs.columns))
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("words") < F.col("size"), F.length(text).cast("bigint")).otherwise(F.col("row.n_chars"))
    return uses.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json", 2).drop("ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier and a tokenizer are no SQL; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
