"""Dataset versions: schedules, counts, content hashes and ground-truth validation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.geometry import has_area
from quirefold.operators.matching import FOLD_BOXES, overlapping_pairs
from quirefold.operators.ordering import HOT_ROWS, position
from quirefold.session import materialize

# Lists are hashed in runs of this many entries, then the run digests are hashed, three
# levels deep, so the content hash of a list of any length never gathers it in one place.
FAN_IN = 4096


def dataset_schedule(specs: DataFrame) -> DataFrame:
    """Page plan of each spec row (``name, total, calib, bench, two_up``): template, seed, split."""
    i = F.col("page_index")
    plan = specs.where(F.col("total") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)).alias("page_index"))
    names = F.array(*[F.lit(t) for t in K.TEMPLATES])
    template = F.when(F.col("two_up") & (i % 5 == 0), "two_up").otherwise(F.element_at(names, (i % len(K.TEMPLATES) + 1).cast("int")))
    calib = F.when(F.col("calib") > 0, F.least(F.col("calib"), F.floor(F.col("total") / 5))).otherwise(0)
    split = F.when(i < calib, "calib").when(F.col("bench"), "bench").otherwise("test")
    return plan.select("name", "page_index", template.alias("template"), (i + K.PAGE_SEED_BASE).alias("seed"), split.alias("split"))


def dataset_counts(truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long counts (axis, name, n): pages in all, pages by split, boxes by class."""
    cells = truth.groupBy(*keys, "page_id", "split", "label").agg(F.count("*").alias("boxes"))
    pages = cells.select(*keys, "page_id", "split").distinct().groupBy(*keys, "split").agg(F.count("*").alias("n"))
    by_class = cells.groupBy(*keys, F.lit("class").alias("axis"), F.col("label").alias("name")).agg(F.sum("boxes").alias("n"))
    total = pages.groupBy(*keys, F.lit("pages").alias("axis"), F.lit("").alias("name")).agg(F.sum("n").alias("n"))
    return total.unionByName(pages.select(*keys, F.lit("split").alias("axis"), F.col("split").alias("name"), "n")).unionByName(by_class)


def load_truth(annotations: DataFrame, pages: DataFrame, datasets: DataFrame, name: str | None = None, split: str | None = None) -> DataFrame:
    """Truth boxes with page size and dataset name and version, kept long."""
    a = annotations if split is None else annotations.where(F.col("split") == split)
    d = datasets if name is None else datasets.where(F.col("name") == name)
    p = pages.select("ws", F.col("id").alias("page_id"), "width_px", "height_px")
    v = d.select("ws", F.col("id").alias("dataset_version_id"), F.col("name").alias("dataset"), "semver")
    return a.join(p, ["ws", "page_id"]).join(v, ["ws", "dataset_version_id"])


def category_axis(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every class id from 0 to the largest, with ``class_<id>`` where no label is known."""
    top = labels.groupBy(*keys).agg(F.max("class_id").alias("_top"))
    axis = top.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias("class_id"))
    return axis.join(labels, [*keys, "class_id"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("class_"), F.col("class_id"))))


def manifest_conflicts(datasets: DataFrame) -> DataFrame:
    """Distinct manifest hashes under one (ws, name, semver)."""
    one = datasets.groupBy("ws", "name", "semver", "manifest_hash").agg(F.bool_and("synthetic").alias("synthetic"))
    return one.groupBy("ws", "name", "semver").agg(F.count("*").alias("hashes"), F.bool_and("synthetic").alias("synthetic")).withColumn("conflict", F.col("hashes") > 1)


class MissingDataset(ValueError):
    """An evaluation set is absent; the run must fail instead of skipping a gate."""


def require_dataset(truth: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        if truth.where(F.col("dataset") == name).isEmpty():
            raise MissingDataset(name)
    return truth


# -- content hashes ---------------------------------------------------------------------------


def ordered_digest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """SHA-256 identity of the ordered list of ``text`` per key."""
    return _folded(df.select("*", _digest(text)), keys, order, name, hot_rows)


def _digest(text: Column) -> Column:
    """Column ``_d``: 32 bytes travel in place of 64 hex digits."""
    return F.unhex(F.sha2(text, 256)).alias("_d")


def _folded(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, hot_rows: int) -> DataFrame:
    level = position(rows, keys, order, "_i", hot_rows).select(*keys, (F.col("_i") - 1).alias("_i"), "_d")
    for _ in range(3):
        level = (
            level.groupBy(*keys, F.floor(F.col("_i") / FAN_IN).alias("_i"))
            .agg(F.sort_array(F.collect_list(F.struct("_i", "_d"))).alias("_l"))
            .select(*keys, "_i", _digest(F.array_join(F.transform("_l", lambda e: F.lower(F.hex(e["_d"]))), ",")))
        )
    return level.select(*keys, F.lower(F.hex("_d")).alias(name))


def box_text(class_id: str = "class_id") -> Column:
    """A box as fixed three-decimal text with its class id."""
    return F.concat_ws(",", *[F.format_string("%.3f", F.round(c, 3)) for c in ("x1", "y1", "x2", "y2")], F.col(class_id).cast("string"))


def annotation_hash(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    return ordered_digest(boxes, keys, order, box_text(), "annotation_hash", hot_rows)


def manifest_hash(pages: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hash over (page sha, annotation hash, split) in page order; ids play no part."""
    # pages come out of digests of all their boxes: they are made once, not again for the size of a group and for its slices
    text, places = F.concat_ws("|", "page_sha", "annotation_hash", "split"), [f"_o{i}" for i in range(len(order))]
    rows = materialize(pages.select(*keys, *[o.alias(n) for o, n in zip(order, places)], _digest(text)))
    return _folded(rows, keys, [F.col(n) for n in places], "manifest_hash", hot_rows)


def provenance_text(generator: Column, version: Column, seed: Column, template: Column, degrade: Column) -> Column:
    tail = F.when(degrade.isNotNull(), F.concat(F.lit(",degrade="), degrade)).otherwise("")
    return F.concat(F.lit("synthetic:"), generator, F.lit("@"), version, F.lit("#seed="), seed.cast("string"), F.lit(",template="), template, tail)


def provenance_parts(text: Column) -> Column:
    pattern = r"^synthetic:([^@]+)@([^#]+)#seed=(\d+),template=([^,]+)(?:,degrade=(.+))?$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("generator"), part(2).alias("version"), part(3).cast("bigint").alias("seed"), part(4).alias("template"), part(5).alias("degrade"))


# -- ground-truth validation -------------------------------------------------------------------


def gt_box_issues(
    boxes: DataFrame, pages: DataFrame, names: Sequence[str] = K.CLASS_NAMES, max_iou: float = K.MAX_SAME_CLASS_IOU, limit: int = FOLD_BOXES,
) -> DataFrame:
    """(ws, page_id, rule, box_id, n): empty pages, boxes out of bounds, wrong class ids, same-class overlaps.

    Equal boxes of a page and class are one box here, with a count; an overlap is reported
    once for each pair of such boxes, under the smallest id, and ``n`` says how many pairs of
    boxes it stands for. A page full of equal boxes gives one row. Box ids are unique on a page.
    """
    key = ["ws", "page_id"]
    # one join tells empty pages and frames the boxes of the others
    framed = pages.select(*key, "width", "height").join(boxes.withColumn("_there", F.lit(True)), key, "left")
    inside = (F.col("x1") >= 0) & (F.col("x1") < F.col("x2")) & (F.col("x2") <= F.col("width")) & (F.col("y1") >= 0) & (F.col("y1") < F.col("y2")) & (F.col("y2") <= F.col("height"))
    ids = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    named = F.coalesce(F.try_element_at(ids, F.col("label")) == F.col("class_id"), F.lit(False))
    bare = F.col("_there").isNull()
    rules = F.array(F.when(bare, "empty").when(~inside, "out_of_bounds"), F.when(~bare & ~named, "class_mismatch"))
    single = framed.select(*key, F.explode(rules).alias("rule"), F.when(bare, F.lit(-1).cast("bigint")).otherwise(F.col("box_id")).alias("box_id")).where(F.col("rule").isNotNull())
    place = [*key, "label", "x1", "y1", "x2", "y2"]
    sets = boxes.groupBy(*place).agg(F.min("box_id").alias("box_id"), F.count("*").alias("n"))
    calm, warm = overlapping_pairs(sets, sets, [*key, "label"], max_iou, strict=True, where=F.col("l_box_id") < F.col("r_box_id"), limit=limit)
    pairs = calm if warm is None else calm.unionByName(warm)
    overlap = lambda df, box, n: df.select(*key, F.lit("same_class_overlap").alias("rule"), box.alias("box_id"), n.alias("n"))
    apart = overlap(pairs, F.col("l_box_id"), F.col("l_n") * F.col("r_n"))
    # boxes with an area overlap their equals fully
    equal = sets.where(has_area() & (F.col("n") > 1) & (F.lit(max_iou) < 1))
    alike = overlap(equal, F.col("box_id"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    one = F.lit(1).cast("bigint").alias("n")
    return single.select("*", one).unionByName(apart).unionByName(alike)


def gt_report(boxes: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Per workspace: pages, boxes, ok, and errors per rule as a map."""
    rules = issues.groupBy("ws", "rule").agg(F.sum("n").alias("n")).groupBy("ws").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n")))).alias("errors"), F.sum("n").alias("n_errors"))
    p = pages.groupBy("ws").agg(F.count("*").alias("pages"))
    b = boxes.groupBy("ws").agg(F.count("*").alias("boxes"))
    return p.join(b, "ws", "left").join(rules, "ws", "left").na.fill({"boxes": 0, "n_errors": 0}).withColumn("ok", F.col("n_errors") == 0)


def ink_masks(pages: DataFrame) -> DataFrame:
    """``ws, page_id, width, height, ink`` from raw RGB pages: one bit a pixel, made where the image is read."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            masks = []
            for raw, width, height in zip(batch["rgb"], batch["width"], batch["height"]):
                pixels = np.frombuffer(raw, np.uint8, count=width * height * 3).reshape(-1, 3)
                masks.append(np.packbits(pixels.mean(axis=1, dtype=np.float32) < K.INK_LEVEL).tobytes())
            yield batch.drop(columns="rgb").assign(ink=masks)

    return pages.select("ws", "page_id", "width", "height", "rgb").mapInPandas(packed, "ws string, page_id bigint, width int, height int, ink binary")


class _PageInk:
    """One page's ink as a summed-area table, so that a box of any size costs four reads, and what its boxes cover."""

    def __init__(self, raw: bytes, width: int, height: int, margin: int) -> None:
        self.width, self.height, self.margin = width, height, margin
        self.ink = np.unpackbits(np.frombuffer(raw, np.uint8), count=width * height).reshape(height, width)
        self.sums = np.zeros((height + 1, width + 1), np.int32)
        np.cumsum(np.cumsum(self.ink, axis=0, dtype=np.int32), axis=1, out=self.sums[1:, 1:])
        self.edges = np.zeros((height + 1, width + 1), np.int32)

    def shares(self, corners: np.ndarray) -> np.ndarray:
        """Ink share of each box ``x1, y1, x2, y2``, which is covered from here on; NaN for boxes not within the page."""
        x1, y1, x2, y2 = corners.T
        inside = (x1 >= 0) & (x1 < x2) & (x2 <= self.width) & (y1 >= 0) & (y1 < y2) & (y2 <= self.height)
        out = np.full(len(corners), np.nan)
        left, top = (np.floor(v[inside]).astype(np.int64) for v in (x1, y1))
        right, low = (np.ceil(v[inside]).astype(np.int64) for v in (x2, y2))
        filled = self.sums[low, right] - self.sums[top, right] - self.sums[low, left] + self.sums[top, left]
        out[inside] = filled / ((right - left) * (low - top))
        for row, column, step in ((top, left, 1), (top, right, -1), (low, left, -1), (low, right, 1)):
            np.add.at(self.edges, (row, column), step)
        return out

    def covered(self) -> tuple[int, int]:
        """Ink inside the margin that some box covers, and all of it."""
        m = self.margin
        window = np.s_[m:max(m, self.height - m), m:max(m, self.width - m)]
        boxed = np.cumsum(np.cumsum(self.edges, axis=0), axis=1)[:-1, :-1] > 0
        return int((self.ink[window].astype(bool) & boxed[window]).sum()), int(self.ink[window].sum())


INK_ISSUE = "ws string, page_id bigint, rule string, box_id bigint, share double"


def gt_ink_issues(pages: DataFrame, boxes: DataFrame, margin: int = K.INK_MARGIN_PX) -> DataFrame:
    """Ink rules over raw RGB pages (``ws, page_id, width, height, rgb``) that have boxes.

    Only ink masks are shuffled. A page's mask comes before its boxes in the partition that
    both are dealt to, and the boxes stream past it: what is held is three images of the
    page, however many boxes it has.
    """
    key, corners = ["ws", "page_id"], ["x1", "y1", "x2", "y2"]
    masks = ink_masks(pages).select(*key, F.lit(0).alias("kind"), "width", "height", "ink")
    marked = boxes.select(*key, F.lit(1).alias("kind"), "box_id", *[F.col(c).cast("double") for c in corners])
    in_order = masks.unionByName(marked, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "kind")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page, boxed = None, None, False
        issues: list[tuple] = []

        def closed() -> None:
            if page is not None and boxed:
                inside, total = page.covered()
                if total and inside / total < K.MIN_INK_COVERAGE:
                    issues.append((*at, "ink_uncovered", -1, inside / total))

        for batch in batches:
            places = list(zip(batch.column("ws").to_pylist(), batch.column("page_id").to_pylist()))
            kinds, start = batch.column("kind").to_pylist(), 0
            while start < len(places):
                if places[start] != at:
                    closed()
                    at, page, boxed = places[start], None, False
                end = start
                while end < len(places) and places[end] == at and kinds[end] == kinds[start]:
                    end += 1
                if kinds[start] == 0:
                    page = _PageInk(batch.column("ink")[start].as_py(), batch.column("width")[start].as_py(), batch.column("height")[start].as_py(), margin)
                elif page is not None:
                    part, boxed = batch.slice(start, end - start), True
                    shares = page.shares(np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in corners], 1))
                    ids = part.column("box_id").to_pylist()
                    issues += [(*at, "no_ink", ids[i], float(shares[i])) for i in np.flatnonzero(shares < K.MIN_INK_FRACTION)]
                start = end
            if issues:
                yield _issue_rows(issues)
                issues.clear()
        closed()
        if issues:
            yield _issue_rows(issues)

    return in_order.mapInArrow(judge, INK_ISSUE)


def _issue_rows(issues: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*issues), types)], [f.split()[0] for f in INK_ISSUE.split(", ")])
