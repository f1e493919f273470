"""Token ids in compressed binary files, written in document order and read back.

Documents are range-partitioned by id and sorted; each task encodes its texts and writes
groups of whole documents of about ``GROUP_IDS`` ids. A group is one row of a Parquet
container: the run of coded blocks (``codec``), the ids and lengths of its documents, and
where it lies. Spark's own writer commits the files, so a lost task leaves nothing behind,
and a group is read without any other. Where a group starts in the whole stream follows
from the totals of the partitions before it.

Null texts count as empty: their only id is the end id. Null document ids come first,
rows that repeat an id are ordered by text. An empty table gives a folder without rows.
Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.codec import decode, encode
from quirefold.llm.common import by_batch, offsets, small_batches, table
from quirefold.llm.encoding import word_ids
from quirefold.session import scratch_root

GROUP_IDS = 1 << 23


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, group_ids: int = GROUP_IDS, remembered: int | None = None) -> None:
    """Write the ids of all documents below ``path``, ``end_id`` after each."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size, id_type = 0, None

        def group() -> pa.RecordBatch:
            ids = np.concatenate(held)
            cols = [
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([encode(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["part", "number", "start", "n_ids", "doc_ids", "lengths", "blocks"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            doc_ids, row = batch.column(0).to_pylist(), 0
            for ids, starts in word_ids(batch.column(1), tokenizer, remembered):
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    names.append(doc_ids[row])
                    lengths.append(b - a + 1)
                    row += 1
                held.append(np.insert(ids, starts[1:], np.uint32(end_id)))
                size += len(held[-1])
                if size >= group_ids:
                    yield group()
                    number, start, size, names, lengths, held = number + 1, start + size, 0, [], [], []
        if held:
            yield group()

    fields = f"part bigint, number bigint, start bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<bigint>, blocks binary"
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(coded, fields).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; its ids too where asked for."""
    groups = spark.read.parquet(path)
    # one row per partition that has rows is ordered here, a few numbers each
    totals = groups.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_ids").over(ahead), F.lit(0)).alias("_base"))
    kind = groups.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        part_of = []
        for row in range(batch.num_rows):
            part, start, doc_ids, lengths, blocks = (batch.column(c)[row].as_py() for c in ("part", "start", "doc_ids", "lengths", "blocks"))
            ids = decode(blocks)
            at = offsets(np.array(lengths, np.int64)).tolist()
            if at[-1] != len(ids):
                raise ValueError(f"part {part}: {len(ids)} ids for documents of {at[-1]}")
            for doc_id, a, b in zip(doc_ids, at[:-1], at[1:]):
                raw = ids[a:b].astype("<u4").tobytes()
                for col, value in zip(cols, (doc_id, start + a, b - a, zlib.crc32(raw), raw if with_ids else None)):
                    col.append(value)
            part_of += [part] * len(doc_ids)
        types = [batch.column("doc_ids").type.value_type, *[pa.int64()] * 3, pa.binary()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(part_of, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids", "part"]
        )

    rows = groups.select("part", "start", "doc_ids", "lengths", "blocks")
    read = by_batch(rows, documents, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary, part bigint")
    placed = read.join(bases, "part").select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return placed if with_ids else placed.drop("ids")


def op8_binout(spark, sf_dir) -> DataFrame:
    path = f"{scratch_root(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 1, remembered=1_200_000)
    return read_ids(spark, path)
