"""A keyed table that a stream adds to, kept as levels of runs.

A trigger adds one run: a folder per hash bucket of the key, a bitmap of the keys in each,
and a manifest that names all runs of the table. When ``FAN`` runs of a level have come
together they are merged into one run of the next level, so after ``n`` triggers there are
about ``FAN * log(n)`` runs, each row is rewritten once per level, and a trigger opens only
the folders whose bitmap may hold one of its keys.

Nothing is in the table before its manifest is. A trigger that is replayed after its
manifest was published finds it and adds nothing; one that died before starts over and
leaves folders that no manifest names. A run is deleted two triggers after it was merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.sources.commits import names_in, publish_document, read_document

BUCKETS, FAN = 64, 8
#: Bits of a bitmap in one row, and bits for each key of a folder.
PART_BITS, ROOM = 32768, 16


def layout_of(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each key's highest ``_version``."""
    return rows.withColumn("_newest", F.max("_version").over(Window.partitionBy(*keys))).where("_version = _newest").drop("_newest")


class LevelledTable:
    """``merge`` is what a merge keeps of the rows of several runs; without it all of them."""

    def __init__(self, spark: SparkSession, root: str, layout: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.root, self.layout, self.keys, self.merge = spark, root, layout, list(keys), merge or (lambda rows: rows)
        self.columns = spark.createDataFrame([], layout).columns
        #: Folders read, for each trigger of this session.
        self.opened: list[int] = []

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(BUCKETS)).cast("int")

    def _slot(self, slots: int) -> Column:
        return F.pmod(F.shiftright(self._hash(), 6), F.lit(slots))

    # -- manifests ----------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.root}/manifests"))

    def _runs(self, before: int | None = None) -> list[dict]:
        """Runs named by the newest manifest, or by the newest one before a trigger."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        return read_document(self.spark, f"{self.root}/manifests/{numbers[-1]:012d}")["runs"] if numbers else []

    def settled(self, number: int) -> bool:
        return number in self._numbers()

    # -- runs ---------------------------------------------------------------------------

    def _folder(self, run: dict, bucket: int) -> str:
        return f"{self.root}/runs/{run['name']}/_bucket={bucket}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.layout).parquet(*folders) if folders else self.spark.createDataFrame([], self.layout)

    def _all(self, runs: list[dict]) -> DataFrame:
        return self._read([self._folder(r, b) for r in runs for b in r["buckets"]])

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        """A new run, or None for no rows."""
        name = uuid.uuid4().hex
        path = f"{self.root}/runs/{name}"
        # rebalancing keeps files few and splits the bucket of a hot key
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        written = self.spark.read.schema(f"{self.layout}, _bucket int").parquet(path)
        sizes = {r["_bucket"]: r["count"] for r in written.groupBy("_bucket").count().collect()}  # one row a bucket
        if not sizes:
            return None
        slots = PART_BITS
        while slots < ROOM * max(sizes.values()):
            slots *= 2
        slot = self._slot(slots)
        marks = written.select("_bucket", F.floor(slot / PART_BITS).alias("part"), (slot % PART_BITS).alias("bit"))
        marks.groupBy("_bucket", "part").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{self.root}/filters/{name}")
        return {"name": name, "level": level, "slots": slots, "buckets": sorted(sizes)}

    def _may_hold(self, keys: DataFrame, runs: list[dict]) -> list[str]:
        """Folders whose bitmap has the bit of one of the keys."""
        out = []
        for slots in sorted({r["slots"] for r in runs}):
            some = [r for r in runs if r["slots"] == slots]
            slot = self._slot(slots)
            wanted = keys.select(self._bucket().alias("_bucket"), F.floor(slot / PART_BITS).alias("part"), (slot % PART_BITS).alias("bit")).distinct()
            paths = [f"{self.root}/filters/{r['name']}" for r in some]
            kept = self.spark.read.schema("_bucket int, part bigint, bits binary").parquet(*paths).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
            byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
            hit = F.expr("shiftright(_byte, int(bit % 8)) & 1") == 1
            found = kept.join(wanted, ["_bucket", "part"]).withColumn("_byte", byte).where(hit).select("run", "_bucket").distinct().collect()
            by_name = {r["name"]: r for r in some}
            out += [self._folder(by_name[f["run"]], f["_bucket"]) for f in found]
        return sorted(out)

    # -- what streams use ---------------------------------------------------------------

    def holding(self, keys: DataFrame, number: int) -> DataFrame:
        """Rows from before this trigger that may belong to ``keys``; the caller joins."""
        folders = self._may_hold(keys, self._runs(number))
        self.opened.append(len(folders))
        return self._read(folders)

    def add(self, rows: DataFrame, number: int) -> None:
        before = self._runs(number)
        made = self._write(rows.select(*self.columns), 0)
        runs, level = before + ([made] if made else []), 0
        while len(full := [r for r in runs if r["level"] == level]) >= FAN:
            merged = self._write(self.merge(self._all(full)), level + 1)
            runs = [r for r in runs if r["level"] != level] + ([merged] if merged else [])
            level += 1
        publish_document(self.spark, f"{self.root}/manifests/{number:012d}", {"runs": runs})
        self._forget(number)

    def _forget(self, number: int) -> None:
        """Runs that the two manifests before the newest one no longer name, and the manifests before those."""
        older = [n for n in self._numbers() if n < number]
        if len(older) < 2:
            return
        manifests = {n: read_document(self.spark, f"{self.root}/manifests/{n:012d}")["runs"] for n in older[-2:]}
        gone = {r["name"] for r in manifests[older[-2]]} - {r["name"] for r in manifests[older[-1]]}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folders = [f"{part}/{name}" for name in gone for part in ("runs", "filters")] + [f"manifests/{n:012d}" for n in older[:-2]]
        for folder in folders:
            path = hadoop.Path(f"{self.root}/{folder}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def rows(self) -> DataFrame:
        """Everything in the table, merged as far as triggers have merged it."""
        return self._all(self._runs())
