"""Detection evaluation: COCO average precision, precision/recall, agreement, shadow diffs.

Frames are long. Truth has ``scope`` columns, ``page_id, box_id, label, x1..y2``;
predictions have the same plus ``candidate, det_id, score``. ``scope`` always carries
the workspace, and usually the dataset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.geometry import has_area
from quirefold.operators.matching import FOLD_BOXES, MASK_STEPS, Levels, match_boxes
from quirefold.operators.ordering import HOT_ROWS, oversize_groups, running_sums
from quirefold.session import materialize

SCOPE = ("ws", "dataset")


class UnknownTruthClass(ValueError):
    """Truth mentions a class outside the category list."""


def check_truth_classes(truth: DataFrame, categories: Sequence[str]) -> None:
    bad = truth.where(~F.col("label").isin(list(categories))).select("label").limit(1).collect()
    if bad:
        raise UnknownTruthClass(bad[0][0])


def eval_inputs(
    truth: DataFrame,
    pred: DataFrame,
    categories: Sequence[str] = K.CLASS_NAMES,
    floor: float = K.SCORE_FLOOR,
    scope: Sequence[str] = SCOPE,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Truth with an area, and predictions above the floor, of a known class, on a truth page."""
    if check:
        check_truth_classes(truth, categories)
    pages = truth.select(*scope, "page_id").distinct()
    kept = pred.where((F.col("score") >= floor) & F.col("label").isin(list(categories)) & has_area())
    return truth.where(has_area()), kept.join(pages, [*scope, "page_id"], "left_semi")


def strongest(pred: DataFrame, scope: Sequence[str] = SCOPE, cap: int = K.MAX_DETS) -> DataFrame:
    """The protocol scores at most ``cap`` detections per page and class; usually no page has more."""
    group = [*scope, "candidate", "page_id", "label"]
    if oversize_groups(pred, group, cap) is None:
        return pred
    best = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("det_id"))
    return pred.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= cap).drop("_rank")


def coco_match(
    truth: DataFrame,
    pred: DataFrame,
    scope: Sequence[str] = SCOPE,
    thresholds: Sequence[float] = K.COCO_IOU_THRESHOLDS,
    limit: int = FOLD_BOXES,
    mask: bool = False,
) -> DataFrame:
    """Greedy matches for every overlap threshold at once: best scores choose first,
    each takes its best free truth, and the later truth wins a tie. With ``mask``, ``thr``
    has one bit for each threshold (see ``Levels``).

    ``pred`` comes from ``strongest``, so the truth side alone decides which pages are hot.
    """
    matched = match_boxes(
        pred.select(*scope, "page_id", "label", "candidate", "det_id", "score", "x1", "y1", "x2", "y2"),
        truth.select(*scope, "page_id", "label", "box_id", "x1", "y1", "x2", "y2"),
        [*scope, "page_id", "label"], "l_det_id", "r_box_id", min(thresholds),
        left_order=[-F.col("l_score"), F.col("l_det_id")], right_order=[-F.col("r_box_id")], keep=["iou"],
        levels=Levels("thr", [(i, min(t, 1 - 1e-10)) for i, t in enumerate(thresholds)], "iou", mask),
        candidate="l_candidate", limit=limit, sized_by=truth,
    )
    return matched.withColumnsRenamed({"l_det_id": "det_id", "r_box_id": "box_id"})


def store_predictions(pred: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """What the curve reads of ``pred``, written once; the summary counts the same rows."""
    return materialize(pred.select(*scope, "candidate", "label", "page_id", "det_id", "score", "x1", "y1", "x2", "y2"))


def pr_curve(
    truth: DataFrame,
    pred: DataFrame,
    scope: Sequence[str] = SCOPE,
    thresholds: Sequence[float] = K.COCO_IOU_THRESHOLDS,
    limit: int = FOLD_BOXES,
    hot_rows: int = HOT_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Precision at 101 recall points per candidate, class and overlap threshold.

    Precision falls between hits, so the envelope only needs the rows that are hits:
    each hit serves the recall points up to its own recall, hits are reduced to the
    best precision per recall point before any ordering, and a running maximum over
    at most 101 points finishes the curve. ``stored`` says that ``pred`` is written already.
    """
    n = len(thresholds)
    group = [*scope, "candidate", "label"]
    # read by the size checks, the matcher and the ranking: compute it once
    pred = strongest(pred if stored else store_predictions(pred, scope), scope)
    hits = (
        coco_match(truth, pred, scope, thresholds, limit, mask=True)
        .groupBy(*group, "page_id", "det_id")
        .agg(F.bit_or("thr").alias("hits"))
    )
    flagged = pred.select(*group, "page_id", "det_id", "score").join(hits, [*group, "page_id", "det_id"], "left")
    bit = lambda i: F.coalesce(F.col("hits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
    one = {f"tp{i}": bit(i).cast("bigint") for i in range(n)}
    walked = running_sums(
        flagged, group, [F.desc("score"), F.asc("page_id"), F.asc("det_id")],
        {"pos": F.lit(1).cast("bigint"), **one}, hot_rows, sized_by=pred,
    )
    positives = truth.groupBy(*scope, "label").agg(F.count("*").alias("npig"))
    axis = positives.join(pred.select(*scope, "candidate").distinct(), list(scope))
    each = F.array(*[F.struct(F.lit(i).alias("thr"), F.col(f"tp{i}").alias("tp"), bit(i).alias("hit")) for i in range(n)])
    recall = F.col("tp") / F.col("npig")
    guess = F.floor(recall * 100)
    point = (
        F.when((guess + 1).cast("double") * 0.01 <= recall, guess + 1)
        .when(guess.cast("double") * 0.01 <= recall, guess)
        .otherwise(guess - 1)
    )
    # the axis has one row per class, so it joins before the rows fan out over thresholds
    best = (
        walked.where(F.col("hits").isNotNull()).join(axis, group)
        .select(*group, "pos", "npig", F.explode(each).alias("_s")).where("_s.hit")
        .select(*group, "pos", "npig", "_s.thr", "_s.tp")
        .groupBy(*group, "thr", F.least(point, F.lit(100)).cast("int").alias("recall_point"))
        .agg(F.max(F.col("tp") / (F.col("pos") + F.lit(K.COCO_EPS))).alias("_p"))
    )
    grid = (
        axis.select(*group, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("thr"))
        .select(*group, "thr", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("recall_point"))
    )
    onwards = Window.partitionBy(*group, "thr").orderBy(F.desc("recall_point")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(best, [*group, "thr", "recall_point"], "left").select(
        *group, "thr", "recall_point", F.coalesce(F.max("_p").over(onwards), F.lit(0.0)).alias("precision")
    )


def class_ap(curve: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    return curve.groupBy(*scope, "candidate", "label").agg(F.round(F.avg("precision"), 5).alias("ap"))


def coco_summary(
    truth: DataFrame, pred: DataFrame, curve: DataFrame, scope: Sequence[str] = SCOPE, listed: DataFrame | None = None
) -> DataFrame:
    """mAP at [.5:.95], .5 and .75 with counts; ``truth`` and ``pred`` are the evaluated inputs.

    ``listed`` is the truth before boxes without area went: every page of it is an image.
    """
    scores = curve.groupBy(*scope, "candidate").agg(
        F.round(F.avg("precision"), 5).alias("map"),
        F.round(F.avg(F.when(F.col("thr") == 0, F.col("precision"))), 5).alias("map50"),
        F.round(F.avg(F.when(F.col("thr") == 5, F.col("precision"))), 5).alias("map75"),
    )
    every = truth if listed is None else listed
    size = (
        every.groupBy(*scope, "page_id").agg(F.sum(has_area().cast("bigint")).alias("_n"))
        .groupBy(*scope).agg(F.count("*").alias("n_images"), F.sum("_n").alias("n_annotations"))
    )
    found = pred.groupBy(*scope, "candidate").agg(F.count("*").alias("n_detections"))
    return scores.join(size, list(scope)).join(found, [*scope, "candidate"])


def coco_empty(axis: DataFrame, summary: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Explicit zeros, with a note, for a candidate that detected nothing."""
    numbers = ["map", "map50", "map75", "n_detections"]
    return axis.join(summary, [*scope, "candidate"], "left").select(
        *scope, "candidate",
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint" if c == "n_detections" else "double")).alias(c) for c in numbers],
        F.when(F.col("map").isNull(), "nothing_detected").otherwise("").alias("note"),
    )


def evaluate(
    truth: DataFrame, pred: DataFrame, categories: Sequence[str] = K.CLASS_NAMES, scope: Sequence[str] = SCOPE,
    floor: float = K.SCORE_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """(summary, per-class AP) for every candidate and scope in one pass."""
    t, p = eval_inputs(truth, pred, categories, floor, scope)
    p = store_predictions(p, scope)
    curve = pr_curve(t, p, scope, stored=True)
    return coco_summary(t, p, curve, scope, truth), class_ap(curve, scope)


def _truth_order_matches(truth: DataFrame, pred: DataFrame, scope: Sequence[str], min_iou: float, thresholds: Sequence[float], limit: int, mask: bool) -> DataFrame:
    return match_boxes(
        truth.select(*scope, "page_id", "label", "box_id", "x1", "y1", "x2", "y2"),
        pred.select(*scope, "page_id", "label", "candidate", "det_id", "score", "x1", "y1", "x2", "y2"),
        [*scope, "page_id", "label"], "l_box_id", "r_det_id", min_iou,
        left_order=[F.col("l_box_id")], right_order=[-F.col("r_det_id")], keep=["r_score"],
        levels=Levels("threshold", [(t, t) for t in thresholds], "r_score", mask),
        candidate="r_candidate", limit=limit,
    )


def precision_recall(
    truth: DataFrame,
    pred: DataFrame,
    thresholds: Sequence[float] = (K.SCORE_THRESHOLD,),
    scope: Sequence[str] = SCOPE,
    min_iou: float = K.MATCH_IOU,
    limit: int = FOLD_BOXES,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Precision and recall at each score threshold; truths choose first, in their own order.

    ``candidates`` (scope columns and ``candidate``) names who is measured; one without a
    prediction gets zeros. Without it, whoever predicted something anywhere is measured.
    """
    pages = truth.select(*scope, "page_id").distinct()
    on_page = pred.join(pages, [*scope, "page_id"], "left_semi")
    counted = lambda i: F.coalesce(F.col(f"_n{i}"), F.lit(0).cast("bigint"))
    steps = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), counted(i).alias("n_pred")) for i, t in enumerate(thresholds)]))
    axis = (pred if candidates is None else candidates).select(*scope, "candidate").distinct()
    counts = on_page.groupBy(*scope, "candidate").agg(*[F.sum((F.col("score") >= t).cast("bigint")).alias(f"_n{i}") for i, t in enumerate(thresholds)])
    offered = axis.join(counts, [*scope, "candidate"], "left").select(*scope, "candidate", steps.alias("_s")).select(*scope, "candidate", "_s.*")
    mask = len(thresholds) <= MASK_STEPS
    matches = _truth_order_matches(truth, on_page, scope, min_iou, thresholds, limit, mask)
    if mask:
        hit = lambda i: F.sum((F.col("threshold").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0).cast("bigint"))
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("tp")) for i, t in enumerate(thresholds)])).alias("_s")
        sums = matches.groupBy(*scope, "candidate").agg(*[hit(i).alias(f"_t{i}") for i in range(len(thresholds))])
        tp = sums.select(*scope, "candidate", each).select(*scope, "candidate", "_s.*")
    else:
        tp = matches.groupBy(*scope, "candidate", "threshold").agg(F.count("*").alias("tp"))
    wanted = truth.groupBy(*scope).agg(F.count("*").alias("n_truth"))
    joined = offered.join(wanted, list(scope)).join(tp, [*scope, "candidate", "threshold"], "left").na.fill({"tp": 0})
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(0.0)
    return joined.select(*scope, "candidate", "threshold", "tp", "n_pred", "n_truth", p.alias("precision"), r.alias("recall")).withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
    )


def best_f1_threshold(
    truth: DataFrame, pred: DataFrame, grid: Sequence[float] = K.F1_GRID, scope: Sequence[str] = SCOPE, limit: int = FOLD_BOXES,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """The threshold with the best F1; the lowest one on ties, also for a candidate that predicts nothing."""
    swept = precision_recall(truth, pred, sorted(grid), scope, limit=limit, candidates=candidates)
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return swept.groupBy(*scope, "candidate").agg(best.alias("_b")).select(*scope, "candidate", "_b.threshold", "_b.f1")


def detection_agreement(
    a: DataFrame, b: DataFrame, page_keys: Sequence[str], min_iou: float = K.AGREEMENT_IOU, limit: int = FOLD_BOXES,
    ident: str = "det_id",
) -> DataFrame:
    """Per page: twice the matched pairs over both counts, best overlaps first, same class only."""
    matched = match_boxes(
        a.select(*page_keys, "label", ident, "x1", "y1", "x2", "y2"),
        b.select(*page_keys, "label", ident, "x1", "y1", "x2", "y2"),
        [*page_keys, "label"], f"l_{ident}", f"r_{ident}", min_iou,
        left_order=[-F.col(f"l_{ident}")], right_order=[-F.col(f"r_{ident}")], overlap_first=True, limit=limit,
    ).groupBy(*page_keys).agg(F.count("*").alias("matched"))
    counts = (
        a.select(*page_keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(*page_keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(*page_keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    )
    return counts.join(matched, list(page_keys), "left").na.fill({"matched": 0}).withColumn(
        "agreement", 2 * F.col("matched") / (F.col("n_a") + F.col("n_b"))
    )


def mean_agreement(
    truth: DataFrame, a: DataFrame, b: DataFrame, scope: Sequence[str] = SCOPE,
    same_weights: Column | None = None, same_path: Column | None = None, limit: int = FOLD_BOXES,
) -> DataFrame:
    """Mean agreement over the truth pages; two empty sides agree.

    NULL unless both sides run the same weights on a different runtime or preprocessing.
    """
    pages = truth.select(*scope, "page_id").distinct()
    per_page = detection_agreement(a, b, [*scope, "page_id"], limit=limit).select(*scope, "page_id", "agreement")
    applies = F.lit(True) if same_weights is None else same_weights & ~same_path
    return (
        pages.join(per_page, [*scope, "page_id"], "left")
        .groupBy(*scope).agg(F.avg(F.coalesce("agreement", F.lit(1.0))).alias("_m"), F.count("*").alias("n_pages"))
        .select(*scope, F.when(applies, F.col("_m")).alias("agreement"), "n_pages")
    )


# -- shadow runs ---------------------------------------------------------------------


def shadow_items(items: DataFrame) -> DataFrame:
    """Each item beside the shadow items of another candidate on the same page and batch."""
    shadows = items.where(F.col("role") == "shadow").select(
        "ws", "batch_id", "page_id", F.col("id").alias("shadow_item_id"), F.col("candidate_id").alias("shadow_candidate_id")
    )
    return items.alias("w").join(
        shadows.alias("s"),
        (F.col("w.ws") == F.col("s.ws")) & (F.col("w.batch_id") == F.col("s.batch_id")) & (F.col("w.page_id") == F.col("s.page_id"))
        & (F.col("w.candidate_id") != F.col("s.shadow_candidate_id")), "left",
    ).select("w.*", "s.shadow_item_id", "s.shadow_candidate_id")


def shadow_predictions(paired: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items beside their shadows with the predictions of both."""
    own = predictions.select("ws", "work_item_id", "candidate_id", F.col("id").alias("_pid"), "detections")
    primary = own.select("ws", F.col("work_item_id").alias("id"), "candidate_id", F.col("_pid").alias("primary_id"),
                         F.col("detections").alias("primary_detections"))
    second = own.select("ws", F.col("work_item_id").alias("shadow_item_id"), F.col("candidate_id").alias("shadow_candidate_id"),
                        F.col("_pid").alias("shadow_id"), F.col("detections").alias("shadow_detections"))
    # items without a shadow would all meet in one partition of the join
    alone = paired.where(F.col("shadow_item_id").isNull()).withColumns({"shadow_id": F.lit(None).cast("string"), "shadow_detections": F.lit(None).cast("string")})
    beside = paired.where(F.col("shadow_item_id").isNotNull()).join(second, ["ws", "shadow_item_id", "shadow_candidate_id"], "left")
    return (
        beside.unionByName(alone).join(primary, ["ws", "id", "candidate_id"], "left")
        .withColumn("has_primary", F.col("primary_id").isNotNull())
        .withColumn("has_shadow", F.col("shadow_id").isNotNull())
    )


def shadow_pairs(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each item with its own prediction and that of the shadow item on the same page and batch."""
    return shadow_predictions(shadow_items(items), predictions)


def shadow_rows(paired: DataFrame, predictions: DataFrame) -> DataFrame:
    """The rows of ``shadow_predictions`` for callers that read no prediction: as many, without its columns.

    A join with predictions that are there once per item and candidate would leave the rows as they are.
    They are counted by a hash: equal ones never escape it, and different ones that meet only cost the join.
    """
    keys = ["ws", "work_item_id", "candidate_id"]
    if oversize_groups(predictions.dropna(subset=keys).select(F.xxhash64(*keys).alias("_h")), ["_h"], 1) is None:
        return paired
    return shadow_predictions(paired, predictions).select(*paired.columns)


def shadow_matches(
    primary: DataFrame, shadow: DataFrame, keys: Sequence[str], min_iou: float = K.AGREEMENT_IOU, limit: int = FOLD_BOXES, sized_by: DataFrame | None = None,
) -> DataFrame:
    """Class-agnostic matches; primaries choose first in their order, later shadows win ties."""
    return match_boxes(
        primary, shadow, keys, "l_pos", "r_pos", min_iou,
        left_order=[F.col("l_pos")], right_order=[-F.col("r_pos")], keep=["l_label", "r_label"], limit=limit, sized_by=sized_by,
    )


def shadow_diff(primary: DataFrame, shadow: DataFrame, keys: Sequence[str], limit: int = FOLD_BOXES) -> DataFrame:
    """Missing, added and relabelled boxes of item pairs whose shadow side is not empty.

    Both frames carry ``keys, pos, label, score, x1..y2``. Boxes and the ends of their matches meet once, by the keys.
    """
    box = lambda side, n: side.select(*keys, F.lit(n).alias("_side"), "pos", "label", F.lit(False).alias("_end"))
    boxes = box(primary, 0).unionByName(box(shadow, 1))
    end = lambda n, pos, label: F.struct(F.lit(n).alias("_side"), F.col(pos).alias("pos"), label.alias("label"), F.lit(True).alias("_end"))
    renamed = F.when(F.col("l_label") != F.col("r_label"), F.concat_ws("->", "l_label", "r_label"))
    m = shadow_matches(primary, shadow, keys, limit=limit, sized_by=boxes)
    ends = m.select(*keys, F.explode(F.array(end(0, "l_pos", renamed), end(1, "r_pos", F.lit(None).cast("string")))).alias("_e")).select(*keys, "_e.*")
    met = (
        boxes.unionByName(ends)
        .withColumn("_live", F.max("_side").over(Window.partitionBy(*keys)) == 1)
        .withColumn("_taken", F.max("_end").over(Window.partitionBy(*keys, "_side", "pos")) & F.col("pos").isNotNull())
    )
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    kind = (
        F.when(F.col("_end"), F.when(F.col("label").isNotNull(), "relabelled"))
        .when(F.col("_taken"), None)
        .when(F.col("_side") == 1, "added")
        .when(F.col("_live") & keyed, "missing")
    )
    return met.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "kind", "pos", "label")


def shadow_agreement(primary: DataFrame, shadow: DataFrame, keys: Sequence[str], limit: int = FOLD_BOXES) -> DataFrame:
    live = shadow.select(*keys).distinct()
    primary = primary.join(live, list(keys), "left_semi")
    matched = shadow_matches(primary, shadow, keys, limit=limit).groupBy(*keys).agg(F.count("*").alias("matched"))
    total = primary.select(*keys).unionByName(shadow.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return total.join(matched, list(keys), "left").select(
        *keys, F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched"),
        F.round(2 * F.coalesce("matched", F.lit(0)) / F.col("n"), 4).alias("agreement"))


def class_ap_delta(candidate_ap: DataFrame, reference_ap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate classes beside the reference's; the delta is NULL where the reference has none."""
    # both sides grow alike; unnested rows look smaller than they are, and would be broadcast
    return candidate_ap.select(*keys, F.col("ap").alias("candidate_ap")).join(
        reference_ap.select(*keys, F.col("ap").alias("reference_ap")).hint("merge"), list(keys), "left"
    ).withColumn("delta", F.col("candidate_ap") - F.col("reference_ap"))


def evaluation_row(
    calib: tuple[DataFrame, DataFrame], clean: tuple[DataFrame, DataFrame], shift: tuple[DataFrame, DataFrame], candidate: str, reference: str,
    same_weights: Column | None = None, same_path: Column | None = None, map_floor: float | None = K.SCORE_FLOOR, categories: Sequence[str] = K.CLASS_NAMES,
    scope: Sequence[str] = ("ws",),
) -> DataFrame:
    """One evaluation record per scope; each argument pair is (truth, predictions of all candidates).

    The candidate's threshold with the best F1 on the clean calibration split is frozen;
    precision, recall and the agreement with the reference are measured at it on the clean
    test split. Maps are scored from ``map_floor`` up, or from the frozen threshold where
    it is None.
    """
    who = [candidate, reference]
    axis = clean[0].select(*scope).distinct().select(*scope, F.explode(F.array(*[F.lit(w) for w in who])).alias("candidate"))
    mine = axis.where(F.col("candidate") == candidate)
    only = lambda pred: pred.where(F.col("candidate") == candidate)
    chosen = materialize(best_f1_threshold(calib[0], only(calib[1]), scope=scope, candidates=mine).drop("candidate"))
    frozen = lambda pred: pred.join(chosen.select(*scope, "threshold"), list(scope)).where(F.col("score") >= F.col("threshold")).drop("threshold")
    at_threshold = materialize(frozen(clean[1].where(F.col("candidate").isin(who))))
    pr = precision_recall(clean[0], only(at_threshold), (0.0,), scope, candidates=mine)
    agree = mean_agreement(clean[0], only(at_threshold), at_threshold.where(F.col("candidate") == reference), scope, same_weights, same_path)

    # both test sets are matched and scored in one pass, the set being one more column of the scope
    sets, wide = {"clean": clean, "shift": shift}, [*scope, "_set"]
    truth, pred = (reduce(lambda a, b: a.unionByName(b), [sides[i].withColumn("_set", F.lit(name)) for name, sides in sets.items()]) for i in (0, 1))
    pred = pred.where(F.col("candidate").isin(who))
    t, p = eval_inputs(truth, frozen(pred) if map_floor is None else pred, categories, map_floor or 0.0, wide)
    p = store_predictions(p, wide)
    every = axis.select("*", F.explode(F.array(*[F.lit(name) for name in sets])).alias("_set"))
    scored = materialize(coco_empty(every, coco_summary(t, p, pr_curve(t, p, wide, stored=True), wide, truth), wide))

    out = chosen.select(*scope, F.col("threshold").alias("operating_threshold"), F.round("f1", 5).alias("calib_f1"))
    out = out.join(pr.select(*scope, F.round("precision", 5).alias("precision"), F.round("recall", 5).alias("recall")), list(scope), "left")
    for name in sets:
        for side, label in ((candidate, "candidate"), (reference, "reference")):
            columns = [F.col(c).alias(f"{name}_{label}{c.removeprefix('map') and '_' + c}") for c in ("map", "map50")]
            out = out.join(scored.where((F.col("candidate") == side) & (F.col("_set") == name)).select(*scope, *columns), list(scope), "left")
    return out.join(agree.select(*scope, F.round("agreement", 5).alias("agreement")), list(scope), "left")
