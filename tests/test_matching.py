"""Greedy matchers against plain loops; ``limit=0`` forces the path for hot pages."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.operators import datasets, detect, evaluate as E

LIMITS = [256, 0]
TRUTH = "ws string, dataset string, page_id long, box_id long, label string, x1 double, y1 double, x2 double, y2 double"
PRED = "candidate string, ws string, dataset string, page_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def scene(seed, pages=6, boxes=25, copies=True):
    """Crowded pages with ties in score, ties in overlap, exact copies and flat boxes."""
    rng = random.Random(seed)
    truth, pred, ids = [], [], iter(range(1, 10**6))
    for page in range(pages):
        for _ in range(boxes):
            x, y, w, h = rng.randrange(60), rng.randrange(60), rng.choice([4, 9, 20, 33, 70]), rng.choice([0, 5, 11, 40, 64])
            label = rng.choice(["text", "table"])
            truth.append(("w", "d", page, next(ids), label, float(x), float(y), float(x + w), float(y + h)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                dx, dy = (0, 0) if copies and rng.random() < 0.4 else (rng.randrange(3), rng.randrange(3))
                pred.append(("c", "w", "d", page, next(ids), label if rng.random() < 0.9 else "title", rng.randrange(20) / 20, float(x + dx), float(y + dy), float(x + w + dx), float(y + h + dy)))
    return truth, pred


def take(pairs):
    used_l, used_r, out = set(), set(), []
    for _, l, r in sorted(pairs):
        if l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), out.append((l, r))
    return set(out)


@pytest.mark.parametrize("limit", LIMITS)
def test_agreement_matches_plain_greedy(spark, limit):
    _, pred = scene(3)
    a, b = pred[::2], pred[1::2]
    want = {}
    for page in {p[3] for p in pred}:
        left, right = [p for p in a if p[3] == page], [p for p in b if p[3] == page]
        pairs = [((-iou(l[7:], r[7:]), -l[4], -r[4]), l[4], r[4]) for l in left for r in right if l[5] == r[5] and iou(l[7:], r[7:]) >= 0.6]
        want[page] = (len(take(pairs)), len(left), len(right))
    frames = [spark.createDataFrame(x, PRED) for x in (a, b)]
    got = E.detection_agreement(*frames, ["ws", "dataset", "page_id"], min_iou=0.6, limit=limit).collect()
    assert {r.page_id: (r.matched, r.n_a, r.n_b) for r in got} == want


@pytest.mark.parametrize("limit", LIMITS)
def test_nms_matches_plain_greedy(spark, limit):
    _, pred = scene(5, boxes=40)
    want = set()
    for page in {p[3] for p in pred}:
        for label in ("text", "table", "title"):
            kept = []
            for p in sorted((p for p in pred if p[3] == page and p[5] == label), key=lambda p: (-p[6], p[4])):
                if all(iou(p[7:], k[7:]) <= 0.4 for k in kept):
                    kept.append(p)
            want |= {k[4] for k in kept}
    df = spark.createDataFrame(pred, PRED)
    got = detect.merge_tiles(df, class_col="label", max_iou=0.4, limit=limit)
    assert sorted(got.columns) == sorted(df.columns)
    assert {r.det_id for r in got.collect()} == want


def coco_by_hand(truth, pred):
    """The published matching and accumulation rules, one class at a time."""
    cats = sorted({t[4] for t in truth if t[7] > t[5] and t[8] > t[6]})
    out = {}
    for cat in cats:
        npig = sum(1 for t in truth if t[4] == cat and t[7] > t[5] and t[8] > t[6])
        for thr in K.COCO_IOU_THRESHOLDS:
            marks = []
            for page in sorted({t[2] for t in truth}):
                gts = [t for t in truth if t[2] == page and t[4] == cat and t[7] > t[5] and t[8] > t[6]]
                dts = sorted((p for p in pred if p[3] == page and p[5] == cat and p[6] >= 0.05 and p[9] > p[7] and p[10] > p[8]), key=lambda p: (-p[6], p[4]))[:100]
                used = set()
                for d in dts:
                    best, m = min(thr, 1 - 1e-10), None
                    for g in gts:
                        if g[3] in used or iou(d[7:], g[5:]) < best:
                            continue
                        best, m = iou(d[7:], g[5:]), g[3]
                    if m is not None:
                        used.add(m)
                    marks.append((-d[6], page, d[4], m is not None))
            tp, pr, rc = 0, [], []
            for n, mark in enumerate(sorted(marks), 1):
                tp += mark[3]
                pr.append(tp / (n + K.COCO_EPS)), rc.append(tp / npig)
            for i in range(len(pr) - 1, 0, -1):
                pr[i - 1] = max(pr[i - 1], pr[i])
            out[cat, thr] = [next((p for p, r in zip(pr, rc) if r >= i * 0.01), 0.0) for i in range(101)]
    return out


@pytest.mark.parametrize("limit,hot_rows", [(256, 10**6), (0, 0)])
def test_coco_curve_and_map(spark, limit, hot_rows):
    truth, pred = scene(11, pages=4, boxes=14)
    want = coco_by_hand(truth, pred)
    t, p = E.eval_inputs(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(pred, PRED))
    curve = E.pr_curve(t, p, limit=limit, hot_rows=hot_rows).cache()
    got = {(r.label, K.COCO_IOU_THRESHOLDS[r.thr], r.recall_point): r.precision for r in curve.collect()}
    assert len(got) == 101 * len(want)
    for (cat, thr), points in want.items():
        for i, v in enumerate(points):
            assert got[cat, thr, i] == pytest.approx(v, abs=1e-12), (cat, thr, i)
    mean = sum(sum(v) / 101 for v in want.values()) / len(want)
    assert E.coco_summary(t, p, curve).first().map == pytest.approx(mean, abs=1e-5)


@pytest.mark.parametrize("limit", LIMITS)
def test_precision_recall_in_truth_order(spark, limit):
    truth, pred = scene(17)
    tp, n = {t: 0 for t in K.F1_GRID}, {t: sum(p[6] >= t for p in pred) for t in K.F1_GRID}
    for thr in K.F1_GRID:
        for page in {t[2] for t in truth}:
            dets, used = [p for p in pred if p[3] == page and p[6] >= thr], set()
            for t in (t for t in truth if t[2] == page):
                best, m = 0.5, None
                for d in dets:
                    if d[4] in used or d[5] != t[4] or iou(t[5:], d[7:]) < best:
                        continue
                    best, m = iou(t[5:], d[7:]), d[4]
                if m is not None:
                    used.add(m)
                    tp[thr] += 1
    out = E.precision_recall(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(pred, PRED), K.F1_GRID, limit=limit).collect()
    assert {r.threshold: (r.tp, r.n_pred) for r in out} == {t: (tp[t], n[t]) for t in K.F1_GRID}


def one(spark, truth, pred):
    rows_t = [("w", "d", page, i, label, *map(float, box)) for i, (page, label, box) in enumerate(truth)]
    rows_p = [("c", "w", "d", page, 100 + i, label, score, *map(float, box)) for i, (page, label, score, box) in enumerate(pred)]
    return spark.createDataFrame(rows_t, TRUTH), spark.createDataFrame(rows_p, PRED)


def test_perfect_and_low_overlap_ap(spark):
    t, p = one(spark, [(1, "text", (0, 0, 50, 50))], [(1, "text", 0.9, (0, 0, 50, 50))])
    summary, ap = E.evaluate(t, p)
    assert summary.first().map == 1.0 and ap.first().ap == 1.0
    t, p = one(spark, [(1, "text", (0, 0, 100, 100))], [(1, "text", 0.9, (30, 30, 70, 70))])
    assert E.evaluate(t, p)[0].first().map == 0.0


def test_two_thirds_precision_full_recall(spark):
    t, p = one(spark, [(1, "text", (0, 0, 50, 50)), (1, "table", (100, 0, 150, 50))],
               [(1, "text", 0.9, (0, 0, 50, 50)), (1, "table", 0.9, (100, 0, 150, 50)), (1, "text", 0.8, (200, 200, 250, 250))])
    r = E.precision_recall(t, p).first()
    assert (r.precision, r.recall) == (pytest.approx(2 / 3), 1.0)


def test_unknown_truth_class_raises(spark):
    t, p = one(spark, [(1, "cat", (0, 0, 5, 5))], [(1, "text", 0.9, (0, 0, 5, 5))])
    with pytest.raises(E.UnknownTruthClass):
        E.eval_inputs(t, p)


def test_score_floor_and_silent_candidate(spark):
    t, p = one(spark, [(1, "text", (0, 0, 50, 50))], [(1, "text", 0.01, (0, 0, 50, 50))])
    tt, pp = E.eval_inputs(t, p)
    assert pp.isEmpty()
    row = E.coco_empty(p.select("ws", "dataset", "candidate").distinct(), E.coco_summary(tt, pp, E.pr_curve(tt, pp))).first()
    assert (row.map, row.n_detections) == (0.0, 0) and row.note


def test_best_f1_prefers_the_lowest_threshold_on_ties(spark):
    t, p = one(spark, [(1, "text", (0, 0, 50, 50))], [(1, "text", 0.35, (0, 0, 50, 50)), (1, "text", 0.27, (200, 0, 250, 50))])
    r = E.best_f1_threshold(t, p).first()
    assert (r.threshold, r.f1) == (0.3, 1.0)


def test_agreement_of_missing_sides(spark):
    t, p = one(spark, [(1, "text", (0, 0, 5, 5)), (2, "text", (0, 0, 5, 5))], [(1, "text", 0.9, (0, 0, 5, 5))])
    assert E.mean_agreement(t, p, p.where("false")).first().agreement == 0.5
    assert E.mean_agreement(t, p, p).first().agreement == 1.0
    assert E.mean_agreement(t, p, p, same_weights=F.lit(False), same_path=F.lit(False)).first().agreement is None


@pytest.mark.parametrize("limit", LIMITS)
def test_same_class_overlaps(spark, limit):
    truth, _ = scene(23, pages=3, boxes=30)
    boxes = spark.createDataFrame(truth, TRUTH).withColumn("class_id", F.when(F.col("label") == "text", 9).otherwise(8))
    pages = boxes.select("ws", "page_id").distinct().selectExpr("*", "100 AS width", "90 AS height").union(spark.createDataFrame([("w", 99, 10, 10)], "ws string, page_id long, width int, height int"))
    got = datasets.gt_box_issues(boxes, pages, limit=limit).groupBy("rule").count().collect()
    pairs = sum(1 for a in truth for b in truth if a[2] == b[2] and a[4] == b[4] and a[3] < b[3] and iou(a[5:], b[5:]) > 0.3)
    outside = sum(1 for t in truth if not (t[5] < t[7] <= 100 and t[6] < t[8] <= 90))
    assert {r["rule"]: r["count"] for r in got} == {"empty": 1, "same_class_overlap": pairs, "out_of_bounds": outside}


@pytest.mark.parametrize("limit", LIMITS)
def test_equal_boxes_of_a_page_are_counted_without_listing_their_pairs(spark, limit):
    truth, _ = scene(29, pages=2, boxes=12)
    many = [(*truth[0][:3], 10_000 + i, "text", *at) for i, at in enumerate([(5.0, 5.0, 40.0, 40.0)] * 3000 + [(6.0, 5.0, 40.0, 40.0)] * 200 + [(7.0, 7.0, 7.0, 9.0)] * 50)]
    truth = truth + many
    boxes = spark.createDataFrame(truth, TRUTH).withColumn("class_id", F.when(F.col("label") == "text", 9).otherwise(8))
    pages = boxes.select("ws", "page_id").distinct().selectExpr("*", "100 AS width", "90 AS height")
    got = datasets.gt_box_issues(boxes, pages, limit=limit).where("rule = 'same_class_overlap'").groupBy("page_id").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    want, places = {}, {}
    for t in truth:
        places.setdefault((t[2], t[4], t[5:]), []).append(t[3])
    found = list(places.items())
    for i, ((page, label, a), ids) in enumerate(found):
        if iou(a, a) > 0.3:
            want[page] = want.get(page, 0) + len(ids) * (len(ids) - 1) // 2
        for (other, kind, b), more in found[i + 1 :]:
            if (page, label) == (other, kind) and iou(a, b) > 0.3:
                want[page] += len(ids) * len(more)
    assert {r.page_id: r.n for r in got} == {p: n for p, n in want.items() if n}
    assert sum(r.rows for r in got) < 200


def test_tile_boundaries(spark):
    sizes = [(1651, 1275), (2200, 1700), (2420, 1870), (400, 4000)]
    pages = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "id int, width_px int, height_px int")
    tiles = {}
    for r in detect.tile_plan(pages).collect():
        tiles.setdefault(r.id, []).append((r.origin_x, r.origin_y, r.tile_w, r.tile_h))
    assert [len(tiles[i]) for i in range(4)] == [1, 1, 2, 2]
    assert sorted(tiles[2]) == [(0, 0, 1210 + 363, 1870), (1210, 0, 1210, 1870)]
    assert sorted(tiles[3]) == [(0, 0, 400, 2600), (0, 2000, 400, 2000)]


def test_one_query_may_give_two_classes(spark):
    logits = spark.createDataFrame([(1, 0, q * 17 + c, v) for q in range(3) for c in range(17) for v in [5.0 if (q, c) in ((0, 8), (0, 9)) else -5.0]], "page_id long, tile_id int, pos int, v double")
    boxes = spark.createDataFrame([(1, 0, q, 0.5, 0.5, 1.0, 1.0) for q in range(3)], "page_id long, tile_id int, q int, cx double, cy double, w double, h double")
    tiles = spark.createDataFrame([(1, 0, 800.0, 1000.0, 400, 0)], "page_id long, tile_id int, scale_x double, scale_y double, origin_x int, origin_y int")
    out = detect.postprocess(logits, boxes, tiles, {8: "table"}, 3, 17).collect()
    assert sorted(r.label for r in out) == ["class_9", "table"]
    assert {(r.x1, r.y1, r.x2, r.y2) for r in out} == {(400.0, 0.0, 1200.0, 1000.0)}


def jobs_of(spark, work):
    """How many Spark jobs some work starts, and what it gives."""
    group = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_jobs_do_not_follow_a_chain_of_ties(spark):
    """Boxes that each overlap the next one fall alternately; a chain twenty times as long takes no more jobs."""
    jobs = {}
    for n in (15, 300):
        chain = [("c", "w", "d", 1, i, "text", 1.0 - i / 1000, float(3 * i), 0.0, float(3 * i + 10), 10.0) for i in range(n)]
        df = spark.createDataFrame(chain, PRED)
        jobs[n], kept = jobs_of(spark, lambda: {r.det_id for r in detect.merge_tiles(df, class_col="label", max_iou=0.5, limit=0).collect()})
        assert kept == set(range(0, n, 2))
    assert jobs[300] <= jobs[15] + 6, jobs  # the old rounds took three jobs for every second box


def test_thousands_of_equal_boxes(spark):
    """Equal boxes are one vertex: all of the smaller side are matched, in order, without their pairs."""
    box = (10.0, 10.0, 30.0, 30.0)
    truth = spark.range(3000).selectExpr("'w' AS ws", "'d' AS dataset", "1L AS page_id", "id AS box_id", "'text' AS label", *[f"{v} AS {c}" for v, c in zip(map("CAST({} AS DOUBLE)".format, box), ("x1", "y1", "x2", "y2"))])
    pred = truth.where("box_id < 2000").selectExpr("'c' AS candidate", "ws", "dataset", "page_id", "box_id AS det_id", "label", "CAST(0.5 AS DOUBLE) AS score", "x1", "y1", "x2", "y2")
    r = E.precision_recall(truth, pred).first()
    assert (r.tp, r.n_pred, r.n_truth) == (2000, 2000, 3000)
    m = E.coco_match(truth, pred, limit=64).where("thr = 9").select("det_id", "box_id").collect()
    # detections in order, each the latest free truth
    assert {x.det_id: x.box_id for x in m} == {i: 2999 - i for i in range(2000)}


def test_empty_pages_and_frames_come_from_one_join(spark):
    rows = [("w", 1, "text", 1, 9, 0.0, 0.0, 5.0, 5.0), ("w", 1, "title", 2, 9, 0.0, 6.0, 50.0, 9.0), ("w", 1, "text", None, 9, 7.0, 7.0, 6.0, 9.0), (None, 4, "odd", 5, 0, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], *r[5:]) for r in rows], "ws string, page_id long, label string, box_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    pages = spark.createDataFrame([("w", 1, 10, 10), ("w", 2, 10, 10), ("w", 2, 10, 10), (None, 4, 10, 10)], "ws string, page_id long, width int, height int")
    issues = datasets.gt_box_issues(boxes, pages)
    got = sorted((str(r.ws), r.page_id, r.rule, str(r.box_id), r.n) for r in issues.collect())
    assert got == sorted([
        ("w", 1, "out_of_bounds", "2", 1), ("w", 1, "class_mismatch", "2", 1), ("w", 1, "out_of_bounds", "None", 1),
        ("w", 2, "empty", "-1", 1), ("w", 2, "empty", "-1", 1), ("None", 4, "empty", "-1", 1)])
    assert "LeftAnti" not in issues._jdf.queryExecution().optimizedPlan().toString()
