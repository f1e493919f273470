"""Packing documents into training sequences by bounded-space online best fit.

Each task keeps at most ``windows`` open sequences. A document's ids fill whole
sequences first; the rest goes to the open window it fits most closely. When it fits
none and no window may be opened, the fullest is topped up with the head of the rest and
emitted. What a task leaves open is merged into at most one unfinished sequence, and the
unfinished sequences of all tasks are merged in groups of ``FAN_IN`` until one is left,
the only one with more padding than ``MIN_CUT``.

The pieces of the first pass are written once to the shared folder; a few thousand ids
per task travel on for merging, nothing else does. Null and empty texts are one piece
with the end id. Repeated ids are packed row by row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import small_batches, table
from quirefold.llm.encoding import word_ids
from quirefold.session import materialize

LENGTH, WINDOWS, FAN_IN = 4096, 32, 64
#: A hole below this many ids is padded rather than filled with a sliver of a document.
MIN_CUT = 16
WIDTH = 4
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, unfinished boolean, ids binary, part bigint"


class Packer:
    """Best fit over a fixed number of open windows; a piece is (doc_id, doc_tokens, start, ids as bytes)."""

    def __init__(self, first_id: int, length: int, windows: int, min_cut: int) -> None:
        self.next_id, self.length, self.windows, self.min_cut = first_id, length, windows, min_cut
        self.open: list[list] = []  # [free, pieces]
        self.done: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> None:
        self.done.append((self.next_id, pieces))
        self.next_id += 1

    def add(self, doc_id, total: int, start: int, ids: bytes) -> None:
        full = self.length * WIDTH
        at = 0
        while len(ids) - at >= full:
            self._emit([(doc_id, total, start + at // WIDTH, ids[at : at + full])])
            at += full
        while at < len(ids):
            need = (len(ids) - at) // WIDTH
            best = fullest = None
            for window in self.open:
                if window[0] >= need and (best is None or window[0] < best[0]):
                    best = window
                if fullest is None or window[0] < fullest[0]:
                    fullest = window
            if best is None and len(self.open) < self.windows:
                best = [self.length, []]
                self.open.append(best)
            if best is not None:
                take, target = need, best
            else:
                take, target = (fullest[0] if fullest[0] >= self.min_cut else 0), fullest
            if take:
                target[1].append((doc_id, total, start + at // WIDTH, ids[at : at + take * WIDTH]))
                target[0] -= take
                at += take * WIDTH
            if best is None or target[0] == 0:
                self.open.remove(target)
                self._emit(target[1])

    def leftover(self) -> list:
        """Merge the open windows; the pieces of the one that stays unfinished."""
        rest = sorted(self.open, key=lambda w: w[0])
        self.open, self.windows = [], 1
        for _, pieces in rest:
            for piece in pieces:
                self.add(*piece)
        return self.open[0][1] if self.open else []


def _rows(packer: Packer, left: list | None, part: int, with_ids: bool, kind: pa.DataType) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(10)]
    for sequence, pieces, unfinished in [*[(s, p, False) for s, p in packer.done], *([(packer.next_id, left, True)] if left else [])]:
        at = 0
        for doc_id, total, start, ids in pieces:
            n = len(ids) // WIDTH
            row = (doc_id, start, n, zlib.crc32(ids), total, sequence, at, unfinished, ids if unfinished or with_ids else None, part)
            for col, value in zip(cols, row):
                col.append(value)
            at += n
    packer.done = []
    types = [kind, *[pa.int64()] * 6, pa.bool_(), pa.binary(), pa.int64()]
    names = ["doc_id", *[c.split()[0] for c in PIECES.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = LENGTH,
    windows: int = WINDOWS,
    min_cut: int = MIN_CUT,
    with_ids: bool = False,
    remembered: int | None = None,
) -> DataFrame:
    """One row per piece: where its ids come from, and where they lie in which sequence.

    ``ids`` (little-endian, four bytes each) is filled with ``with_ids``; ``remembered``
    bounds the words a worker keeps.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, kind = Packer(part << 32, length, windows, min_cut), None
        for batch in batches:
            kind = batch.schema.field(0).type
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, starts in word_ids(batch.column(1), tokenizer, remembered):
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    packer.add(next(doc_ids), b - a + 1, 0, ids[a:b].tobytes() + end)
            yield _rows(packer, None, part, with_ids, kind)
        if kind is not None:
            left = packer.leftover()
            yield _rows(packer, left, part, with_ids, kind)

    with small_batches(docs.sparkSession):
        done = materialize(docs.select("doc_id", "text").mapInArrow(first_pass, schema))
    packed, level = done.where(~F.col("unfinished")), 0
    tails = done.where("unfinished")
    last = tails.agg(F.max("part")).first()[0]

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["_group"].iloc[0])
        packer = Packer((level << 56) + (part << 32), length, 1, min_cut)
        for row in group.sort_values(["part", "offset"]).itertuples():
            packer.add(row.doc_id, row.doc_tokens, row.start, row.ids)
        left = packer.leftover()
        return _rows(packer, left, part, with_ids, pa.array(group["doc_id"]).type).to_pandas()

    while last:
        level, last = level + 1, last // FAN_IN
        step = materialize(tails.withColumn("_group", F.floor(F.col("part") / FAN_IN)).groupBy("_group").applyInPandas(merged, schema))
        packed, tails = packed.unionByName(step.where(~F.col("unfinished"))), step.where("unfinished")
    return packed.unionByName(tails).drop("part", "unfinished")


def op7_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2, remembered=1_200_000).drop("ids")
