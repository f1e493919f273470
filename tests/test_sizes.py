"""Faults that only show on large tables, on small rows that have the same cause."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators import evaluate as E
from quirefold.operators import ingest as I
from quirefold.operators import latency as T
from quirefold.plans import q_detect, q_latency
from tests.test_matching import PRED, TRUTH


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sum_of_ids_passes_the_range_of_a_bigint(spark, monkeypatch):
    big = 8 * 10**18
    boxes = [("w", 1, 1, big + i, 0.5, 100.0 * i, 0.0, 100.0 * i + 50, 50.0) for i in range(3)]
    df = spark.createDataFrame(boxes, "ws string, page_id long, class_id int, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(q_detect, "table", lambda s, d, name: df)
    got = q_detect.merge_tiles(spark, "").first()
    assert (got.kept, got.kept_second, got.id_sum) == (3, 3, float(3 * big + 3))


def test_batch_limits_are_found_without_sorting_the_files(spark):
    mb = 1024 * 1024
    rows = [("a", 1, 26 * mb, 3), ("a", 0, 1, 31), ("b", 1, 1, 31), ("b", 0, 26 * mb, 3), ("c", 5, 26 * mb, 1), ("c", None, 1, 31),
            ("d", 2, 26 * mb, 1), ("d", 2, 1, 31), ("e", 0, 26 * mb, 31), ("f", 0, 1, 1)]
    files = spark.createDataFrame([("w", *r) for r in rows], "ws string, batch_id string, file_no int, byte_size long, pages int")
    out = I.batch_limit_verdict(files)
    assert {r.batch_id: r.verdict for r in out.collect()} == {
        "a": "file_has_too_many_pages", "b": "file_too_large", "c": "file_has_too_many_pages", "d": "file_has_too_many_pages", "e": "file_too_large", "f": "ok"}
    assert "SortAggregate" not in plan(out)


def test_class_deltas_broadcast_no_side(spark):
    one, two = (spark.range(50).select("id", (F.col("id") * f).cast("double").alias("ap")).where(F.col("id") % m != 0) for f, m in ((2, 5), (1, 7)))
    out = E.class_ap_delta(one, two, ["id"])
    assert "Broadcast" not in plan(out)
    assert {r.id: r.delta for r in out.collect()} == {i: float(i) if i % 7 else None for i in range(50) if i % 5}


def levels_of(spark, frames, limit):
    t, p = frames
    step = lambda mask: E.coco_match(t, p, limit=limit, mask=mask).select("page_id", "candidate", "det_id", "box_id", "thr")
    rows = {(r.page_id, r.det_id, r.box_id, r.thr) for r in step(False).collect()}
    return rows, step(True).collect()


@pytest.mark.parametrize("limit", [256, 0])
def test_levels_as_a_mask_are_the_levels_as_rows(spark, limit):
    truth, pred = [], []
    for page in range(30):
        for i in range(1 + page % 3):
            x = 4.0 * i if page % 2 else 100.0 * i
            truth.append(("w", "d", page, 10 * page + i, "text", x, 0.0, x + 40, 30.0))
            pred.append(("c", "w", "d", page, 10 * page + 5 + i, "text", (7 * page + 3 * i) % 10 / 10, x + i, 0.0, x + 40 + page % 7, 30.0))
    rows, masks = levels_of(spark, (spark.createDataFrame(truth, TRUTH), spark.createDataFrame(pred, PRED)), limit)
    assert rows == {(r.page_id, r.det_id, r.box_id, i) for r in masks for i in range(10) if r.thr >> i & 1}
    assert sum(bin(r.thr).count("1") for r in masks) == len(rows)
    if limit:
        # pairs that are in nobody's way are one row, not one for each level
        assert len([r for r in masks if r.page_id % 2 == 0]) == len({m[:3] for m in rows if m[0] % 2 == 0})


ITEM = "ws string, id string, batch_id string, page_id string, role string, candidate_id string, service_ms double"
SEEN = "ws string, id string, work_item_id string, candidate_id string, detections string"


def test_item_view_pairs_items_once(spark):
    """The view reads stored pairs: neither pairs again nor joins predictions that are there once."""
    made = plan(q_latency.item_view(spark, "/root/testdata/sf0.001"))
    assert "batch_id" not in made and "candidate_id" not in made


@pytest.mark.parametrize("twice", [False, True])
def test_rows_of_shadow_pairs_without_their_predictions(spark, twice):
    items = spark.createDataFrame([
        ("w", "i1", "b", "p", "primary", "c1", 1.0), ("w", "i2", "b", "p", "shadow", "c2", 2.0), ("w", "i3", "b", "p", "shadow", "c3", 3.0),
        ("w", "i4", "b", "q", "primary", "c1", 4.0), ("w", "i4", "b", "q", "primary", "c1", 4.0), ("w", None, None, "p", "primary", None, None)], ITEM)
    seen = [("w", "s1", "i1", "c1", "[]"), ("w", "s2", "i2", "c2", None), ("w", None, None, "c1", "[]"), ("w", None, None, "c1", "[]")]
    predictions = spark.createDataFrame(seen + [("w", "s3", "i2", "c2", "[]"), ("w", "s4", "i4", "c1", "[]"), ("w", "s5", "i4", "c1", "[]")] * twice, SEEN)
    paired = E.shadow_items(items)
    rows = E.shadow_rows(paired, predictions)
    assert (rows is paired) is not twice
    key = lambda r: tuple(str(x) for x in r)
    whole = E.shadow_pairs(items, predictions).select(*paired.columns)
    assert sorted(map(key, rows.collect())) == sorted(map(key, whole.collect()))
    assert rows.count() == (12 if twice else 7)


def test_item_view_keeps_rows_without_shadow_page_or_count(spark):
    paired = spark.createDataFrame(
        [("w", "i1", "p", "s1", 1.0), ("w", "i1", "p", "s1", 1.0), ("w", "i2", "p", None, 2.0), ("w", "i3", "none", "s9", None), (None, None, None, None, 5.0)],
        "ws string, id string, page_id string, shadow_item_id string, service_ms double")
    pages = spark.createDataFrame([("w", "p", 10, 20, "upload", False)], "ws string, id string, width_px int, height_px int, provenance string, synthetic boolean")
    counts = spark.createDataFrame([("w", "i1", "s1", 7), ("w", "i2", None, 9)], "ws string, id string, shadow_item_id string, differences bigint")
    rows = T.item_view(paired, pages, counts).select("id", "width_px", "differences", "service_ms").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("i1", 10, 7, 1.0), ("i1", 10, 7, 1.0), ("i2", 10, None, 2.0), ("i3", None, None, None), (None, None, None, 5.0)], key=str)


@pytest.mark.parametrize("limit", [256, 0])
def test_shadow_differences_meet_once(spark, limit):
    """Repeated boxes, null keys, and pairs without boxes on one side; boxes are not shuffled again for each kind."""
    box = lambda k, pos, label, x: ("w", k, pos, label, 0.5, x, 0.0, x + 40.0, 30.0)
    cols = "ws string, id string, pos int, label string, score double, x1 double, y1 double, x2 double, y2 double"
    a = [box("i1", 0, "text", 0.0), box("i1", 1, "table", 100.0), box("i1", 1, "table", 100.0), box("i1", 2, "text", 200.0), box("i2", 0, "text", 0.0), box(None, 0, "text", 0.0)]
    b = [box("i1", 0, "title", 0.0), box("i1", 1, "table", 100.0), box("i1", 2, "text", 300.0), box("i3", 0, "text", 0.0), box("i3", 0, "text", 0.0), box(None, 0, "text", 0.0)]
    out = E.shadow_diff(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), ["ws", "id"], limit=limit)
    if limit:
        assert "LeftAnti" not in plan(out) and "LeftSemi" not in plan(out)
    assert sorted((r.id or "", r.kind, r.pos, r.label) for r in out.collect()) == [
        ("", "added", 0, "text"), ("i1", "added", 2, "text"), ("i1", "missing", 2, "text"), ("i1", "relabelled", 0, "text->title"),
        ("i3", "added", 0, "text"), ("i3", "added", 0, "text")]
