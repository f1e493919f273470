"""What several operators share: table access, word rules, batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries a worker keeps in a per-process cache before it starts over.
CACHE_ENTRIES = 600_000


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Rows of an Arrow batch where a row is a whole text.
TEXT_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs that run inside, where a row is a whole text."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


class WordCache(dict):
    """word -> value, computed on first sight; starts over when it is full, so its memory is bounded."""

    def __init__(self, make: Callable, limit: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


_HOLDER: list[tuple[str, Callable[[], None]]] = []


def hold(name: str, clear: Callable[[], None]) -> None:
    """One operator's cache at a time in a worker: the one that held it before lets go."""
    if not _HOLDER or _HOLDER[0][0] != name:
        for _, let_go in _HOLDER:
            let_go()
        _HOLDER[:] = [(name, clear)]
        pa.default_memory_pool().release_unused()


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs, with the end of the last one."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that ``offsets`` describes; empty runs give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Arrow batch in, Arrow batch out; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
