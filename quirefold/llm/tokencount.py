"""Token counts without keeping a token: Arrow functions return lengths only.

Each task encodes its texts in batches balanced by bytes; long texts are split before
white space, where the vocabulary cannot have a token, so that counts of the parts add
up to the count of the whole. No shuffle; memory is a batch of rows, one segment of text
and a bounded cache.

A null text counts as empty: no bytes, no tokens. Repeated ids are counted row by row;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import by_batch, table
from quirefold.llm.encoding import lengths_of

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [sum(v) for v in lengths_of(tokenizer).values(batch.column(1).to_pylist())]
        tokens = pa.array(np.array(counts, np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_tokencount(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
