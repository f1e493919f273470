"""Detection and evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.geometry import sigmoid
from quirefold.operators import detect as D
from quirefold.operators import evaluate as E
from quirefold.operators.matching import overlapping_pairs
from quirefold.plans.fixtures import oracle, table
from quirefold.session import materialize

CLASSES = ["table", "picture", "text", "title"]


def iou_sql(a: str, b: str) -> str:
    inter = (f"(greatest(0.0::DOUBLE, least({a}x2,{b}x2)-greatest({a}x1,{b}x1)) * "
             f"greatest(0.0::DOUBLE, least({a}y2,{b}y2)-greatest({a}y1,{b}y1)))")
    area = "(greatest(0.0::DOUBLE,{0}x2-{0}x1)*greatest(0.0::DOUBLE,{0}y2-{0}y1))"
    return f"(CASE WHEN {inter} <= 0 THEN 0.0::DOUBLE ELSE {inter} / ({area.format(a)} + {area.format(b)} - {inter}) END)"


def walk_sql(keys: str, order: str, edges: str = "edges") -> str:
    """CTEs that walk ``edges(keys, l, r)`` in order, taking pairs with two free ends, into ``matched``."""
    return f"""
    seq AS (SELECT {keys}, list(struct_pack(l := l, r := r) ORDER BY {order}) AS es FROM {edges} GROUP BY {keys}),
    run AS (
      SELECT {keys}, es, 1 AS i, CAST([] AS STRUCT(l BIGINT, r BIGINT)[]) AS m FROM seq
      UNION ALL
      SELECT {keys}, es, i + 1, CASE WHEN len(list_filter(m, lambda x: x.l = es[i].l OR x.r = es[i].r)) = 0
                                     THEN list_append(m, es[i]) ELSE m END
      FROM run WHERE i <= len(es)),
    matched AS (SELECT {keys}, e.l AS l, e.r AS r FROM (SELECT {keys}, unnest(m) AS e FROM run WHERE i = len(es) + 1) u)"""


# -- inputs ----------------------------------------------------------------------------


def _truth(s, d):
    return table(s, d, "fx_truth")


def _runs(s, d):
    return table(s, d, "fx_runs")


def _candidate(s, d):
    return table(s, d, "fx_pred").withColumn("candidate", F.lit("candidate"))


def _tested(df, split="test"):
    return df.where(F.col("split") == split)


# -- detection queries -------------------------------------------------------------------


def iou(s, d):
    t = table(s, d, "fx_truth").select("ws", "page_id", "box_id", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = table(s, d, "fx_pred").select("ws", "page_id", F.col("det_id").alias("box_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return D.paired_iou(t.join(p, ["ws", "page_id", "box_id"])).select("page_id", "box_id", F.round("iou", 9).alias("iou"))


def iou_pairs(s, d):
    calm, warm = overlapping_pairs(
        table(s, d, "fx_truth").select("ws", "page_id", "label", "box_id", "x1", "y1", "x2", "y2"),
        table(s, d, "fx_pred").select("ws", "page_id", "label", "det_id", "x1", "y1", "x2", "y2"),
        ["ws", "page_id", "label"], 0.5)
    pairs = calm if warm is None else calm.unionByName(warm)
    return pairs.groupBy("ws", "label").agg(
        F.count("*").alias("n_50"), F.sum((F.col("iou") >= 0.75).cast("bigint")).alias("n_75"), F.round(F.avg("iou"), 6).alias("mean_iou"))


def cxcywh_to_xyxy(s, d):
    return D.corners_from_centres(table(s, d, "fx_box_query")).select(
        "page_id", "q", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


def sigmoid_scores(s, d):
    return table(s, d, "fx_raw").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.round(sigmoid(F.col("v").cast("double") * 8), 9).alias("score"))


def check_raw_outputs(s, d):
    raw = table(s, d, "embeddings").select(
        "vec_id", "label",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda q: F.slice("embedding", q * 8 + 1, F.lit(8))).alias("logits"),
        F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 10 == 0, 6).otherwise(7)),
                    lambda q: F.slice("embedding", q * 4 + 1, F.lit(4))).alias("boxes"),
        F.lit(1).alias("n_items"), F.when(F.col("label") == 3, 2).otherwise(1).alias("n_batch"))
    return D.shape_violations(raw).select("vec_id", "reason")


def topk_flat(s, d):
    raw = table(s, d, "fx_raw").select("page_id", "tile_id", "pos", (F.col("v").cast("double") * 8).alias("v"))
    return D.top_scores(raw, 8).select("page_id", F.col("rank").cast("bigint").alias("rank"), F.col("pos").cast("bigint").alias("pos"), F.round("score", 9).alias("score"))


def postprocess(s, d):
    raw = table(s, d, "fx_raw").select("page_id", "tile_id", "pos", (F.col("v").cast("double") * 8).alias("v"))
    labels = {i: K.CLASS_NAMES[i] for i in range(6)}
    out = D.postprocess(raw, table(s, d, "fx_box_query"), table(s, d, "fx_tile"), labels, 8, 8)
    return out.select("page_id", F.col("rank").cast("bigint").alias("rank"), "label", F.round("score", 9).alias("score"),
                      *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def tile_plan(s, d):
    return D.tile_plan(table(s, d, "fx_page").select("id", "width_px", "height_px")).select(
        "id", *[F.col(c).cast("bigint").alias(c) for c in ("tile_id", "origin_x", "origin_y", "tile_w", "tile_h")])


def nms(s, d):
    return D.merge_tiles(table(s, d, "fx_pred_all").select("ws", "page_id", "class_id", "det_id", "score", "x1", "y1", "x2", "y2")).select(
        "page_id", "det_id", "score")


def merge_tiles(s, d):
    """Each page's detections seen by two overlapping tiles: the second copy is shifted and slightly weaker."""
    base = table(s, d, "fx_pred_all").select("ws", "page_id", "class_id", "det_id", "score", "x1", "y1", "x2", "y2")
    again = base.select("ws", "page_id", "class_id", (F.col("det_id") + 1_000_000_000_000_000).alias("det_id"), (F.col("score") * 0.5).alias("score"),
                        (F.col("x1") + 3).alias("x1"), F.col("y1"), (F.col("x2") + 3).alias("x2"), F.col("y2"))
    return D.merge_tiles(base.unionByName(again)).groupBy("ws").agg(
        F.count("*").alias("kept"), F.sum((F.col("det_id") >= 1_000_000_000_000_000).cast("bigint")).alias("kept_second"), F.sum(F.col("det_id").cast("decimal(20,0)")).cast("double").alias("id_sum"))


def crowded_nms(s, d):
    """Suppression where one page holds a twentieth of all boxes."""
    return D.merge_tiles(table(s, d, "fx_crowd_pred").select("ws", "page_id", "class_id", "det_id", "score", "x1", "y1", "x2", "y2")).select("page_id", "det_id", "score")


def crowded_matches(s, d):
    """Precision and recall on such a page, many of whose boxes are equal."""
    pred = table(s, d, "fx_crowd_pred").withColumn("candidate", F.lit("candidate"))
    out = E.precision_recall(table(s, d, "fx_crowd_truth"), pred, (0.2, 0.6))
    return out.select("ws", "threshold", "tp", "n_pred", "n_truth")


def raw_output_parity(s, d):
    two = table(s, d, "embeddings").select(
        "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"),
        F.transform("embedding", lambda x, i: x.cast("double") + (i % 7).cast("double") * 0.0001).alias("b"))
    return D.tensor_diff(two, "a", "b", ["label"]).select(
        "label", *[F.round(c, 8).alias(c) for c in ("max_abs_diff", "mean_abs_diff", "relative_diff")], "within_bound")


def _linear_stub():
    """Eight logits, each the sum of every eighth input: stands in for a pinned model."""

    def predict(batch):
        return np.asarray(batch, dtype=np.float64).reshape(len(batch), -1, 8).sum(axis=1)

    return predict


def score_pages(s, d):
    pages = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("tensor"))
    scored = D.score_pages(pages, _linear_stub, "tensor", [64])
    return scored.select("vec_id", F.posexplode("logits").alias("class_id", "v")).select(
        "vec_id", F.col("class_id").cast("bigint").alias("class_id"), F.round("v", 6).alias("logit"))


# -- evaluation queries -------------------------------------------------------------------


def eval_inputs(s, d):
    t, p = E.eval_inputs(_truth(s, d), _runs(s, d), CLASSES)
    a = t.groupBy("ws", "dataset").agg(F.count("*").alias("n_truth"))
    b = p.groupBy("ws", "dataset", "candidate").agg(F.count("*").alias("n_pred"), F.round(F.sum("score"), 3).alias("score_sum"))
    return b.join(a, ["ws", "dataset"])


def _inputs(s, d, split="test", runs=_runs):
    return E.eval_inputs(_tested(_truth(s, d), split), _tested(runs(s, d), split), CLASSES)


def coco_match(s, d):
    t, p = _inputs(s, d)
    return E.coco_match(t, E.strongest(p)).select("candidate", "page_id", "label", F.col("thr").cast("bigint").alias("thr"), "det_id", "box_id")


def _curve(s, d):
    t, p = _inputs(s, d)
    p = E.store_predictions(p)
    return t, p, E.pr_curve(t, p, stored=True)


def _listed(s, d):
    return _tested(_truth(s, d))


def pr_curve(s, d):
    return _curve(s, d)[2].select("ws", "dataset", "candidate", "label", F.col("thr").cast("bigint").alias("thr"),
                                  F.col("recall_point").cast("bigint").alias("recall_point"), F.round("precision", 9).alias("precision"))


def coco_map(s, d):
    t, p, c = _curve(s, d)
    return E.coco_summary(t, p, c, listed=_listed(s, d))


def class_ap(s, d):
    return E.class_ap(_curve(s, d)[2])


def coco_empty(s, d):
    """A third candidate that never clears the floor still gets a row of zeros."""
    t, p, c = _curve(s, d)
    silent = _runs(s, d).where(F.col("candidate") == "reference").withColumn("candidate", F.lit("silent"))
    axis = _runs(s, d).unionByName(silent).select("ws", "dataset", "candidate").distinct()
    return E.coco_empty(axis, E.coco_summary(t, p, c))


def quality_table(s, d):
    """All candidates on the clean and the scanned set in one job, per workspace."""
    t, p, c = _curve(s, d)
    return E.coco_summary(t, p, c, listed=_listed(s, d)).select("ws", "dataset", "candidate", "map", "map50", "n_images", "n_annotations", "n_detections")


def _measured(s, d):
    """Both candidates and a third that predicts nothing."""
    sets = _truth(s, d).select("ws", "dataset").distinct()
    return sets.select("ws", "dataset", F.explode(F.array(*[F.lit(c) for c in ("candidate", "reference", "silent")])).alias("candidate"))


def precision_recall(s, d):
    out = E.precision_recall(_tested(_truth(s, d)), _tested(_runs(s, d)), candidates=_measured(s, d))
    return out.select("ws", "dataset", "candidate", "tp", "n_pred", "n_truth", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def best_f1_threshold(s, d):
    return E.best_f1_threshold(_tested(_truth(s, d), "calib"), _tested(_runs(s, d), "calib"), candidates=_measured(s, d)).select(
        "ws", "dataset", "candidate", "threshold", F.round("f1", 6).alias("f1"))


def detection_agreement(s, d):
    return E.detection_agreement(table(s, d, "fx_pred"), table(s, d, "fx_ref"), ["ws", "dataset", "page_id"]).select(
        "page_id", "matched", "n_a", "n_b", F.round("agreement", 6).alias("agreement"))


def mean_agreement(s, d):
    return E.mean_agreement(_tested(_truth(s, d)), _tested(table(s, d, "fx_pred")), _tested(table(s, d, "fx_ref"))).select(
        "ws", "dataset", F.round("agreement", 6).alias("agreement"), "n_pages")


def shadow_pairs(s, d):
    return E.shadow_pairs(table(s, d, "fx_item"), table(s, d, "fx_prediction")).select(
        "ws", "id", "shadow_item_id", "has_primary", "has_shadow")


def _shadow_sides(s, d, paired=None):
    """Boxes of primary items and of their shadows; ``paired`` are items beside their shadows, where they are at hand."""
    from quirefold.functions.jsoncols import detection_rows

    keys = ["ws", "id", "shadow_item_id"]
    paired = E.shadow_items(table(s, d, "fx_item")) if paired is None else paired
    live = materialize(
        E.shadow_predictions(paired, table(s, d, "fx_prediction"))
        .where((F.col("role") == "primary") & F.col("has_shadow")).select(*keys, "primary_detections", "shadow_detections"))
    return (detection_rows(live, "primary_detections", keys), detection_rows(live, "shadow_detections", keys), keys)


def shadow_diff(s, d):
    a, b, keys = _shadow_sides(s, d)
    return E.shadow_diff(a, b, keys).select(*keys, "kind", F.col("pos").cast("bigint").alias("pos"), "label")


def shadow_agreement(s, d):
    a, b, keys = _shadow_sides(s, d)
    return E.shadow_agreement(a, b, keys)


def class_ap_delta(s, d):
    ap = table(s, d, "fx_class_ap")
    return E.class_ap_delta(
        ap.where(F.col("cand_ap").isNotNull()).select("candidate", "label", F.col("cand_ap").alias("ap")),
        ap.where(F.col("ref_ap").isNotNull()).select("candidate", "label", F.col("ref_ap").alias("ap")), ["candidate", "label"],
    ).select("candidate", "label", *[F.round(c, 6).alias(c) for c in ("candidate_ap", "reference_ap", "delta")])


def evaluation_row(s, d):
    """The reference of w3 has other weights, so no agreement is asked for there."""
    truth, runs = _truth(s, d), _runs(s, d)
    side = lambda split, dataset: tuple(_tested(f, split).where(F.col("dataset") == dataset) for f in (truth, runs))
    return E.evaluation_row(
        side("calib", "synth-clean"), side("test", "synth-clean"), side("test", "synth-scan"), "candidate", "reference",
        same_weights=F.col("ws") != "w3", same_path=F.lit(False), categories=CLASSES)


QUERIES = {f.__name__: f for f in (
    iou, iou_pairs, cxcywh_to_xyxy, check_raw_outputs, topk_flat, postprocess, tile_plan, nms, merge_tiles, crowded_nms, crowded_matches, raw_output_parity,
    score_pages, eval_inputs, coco_match, pr_curve, coco_map, class_ap, coco_empty, quality_table, precision_recall,
    best_f1_threshold, detection_agreement, mean_agreement, shadow_pairs, shadow_diff, shadow_agreement, class_ap_delta, evaluation_row)}
QUERIES["sigmoid"] = sigmoid_scores

_SIG = "(CASE WHEN {0} >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-({0}))) ELSE exp({0}) / (1.0::DOUBLE + exp({0})) END)"
_V = "(v::DOUBLE * 8)"
_TOP = f"""ranked AS (SELECT page_id, tile_id, pos, {_V} AS v, row_number() OVER (PARTITION BY page_id, tile_id ORDER BY {_V} DESC, pos) AS rank FROM fx_raw),
  top AS (SELECT page_id, tile_id, pos, rank, {_SIG.format('v')} AS score FROM ranked WHERE rank <= 8)"""
_LABELS = "CASE pos % 8 " + " ".join(f"WHEN {i} THEN '{K.CLASS_NAMES[i]}'" for i in range(6)) + " ELSE concat('class_', pos % 8) END"


def _suppress_sql(src: str) -> str:
    a, b = "es[i].", "x."
    return f"""WITH RECURSIVE src AS ({src}),
      seq AS (SELECT ws, page_id, class_id, list(struct_pack(det_id := det_id, score := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2)
                ORDER BY score DESC, det_id) AS es FROM src GROUP BY ws, page_id, class_id),
      run AS (SELECT ws, page_id, class_id, es, 1 AS i,
                CAST([] AS STRUCT(det_id BIGINT, score DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS m FROM seq
              UNION ALL
              SELECT ws, page_id, class_id, es, i + 1,
                CASE WHEN len(list_filter(m, lambda x: {iou_sql(a, b)} > 0.6::DOUBLE)) = 0 THEN list_append(m, es[i]) ELSE m END
              FROM run WHERE i <= len(es)),
      kept AS (SELECT ws, page_id, e.det_id AS det_id, e.score AS score FROM (SELECT ws, page_id, unnest(m) AS e FROM run WHERE i = len(es) + 1) u)"""


_PRED_COLS = "ws, page_id, class_id, det_id, score, x1, y1, x2, y2"
_THR = "(VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(K.COCO_IOU_THRESHOLDS)) + ") AS th(thr, t)"


def _coco_sql(scope: str) -> str:
    on = " AND ".join(f"p.{c} = t.{c}" for c in [*scope.split(", "), "page_id", "label"])
    return f"""WITH RECURSIVE t AS (SELECT * FROM fx_truth WHERE split = 'test'),
      p0 AS (SELECT * FROM fx_runs WHERE split = 'test' AND score >= 0.05::DOUBLE AND ({scope}, page_id) IN (SELECT {scope}, page_id FROM t)),
      p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {scope}, candidate, page_id, label ORDER BY score DESC, det_id) AS rk FROM p0) WHERE rk <= 100),
      pairs AS (SELECT {", ".join("p." + c for c in scope.split(", "))}, p.candidate, p.page_id, p.label, p.det_id AS l, t.box_id AS r, p.score, {iou_sql('p.', 't.')} AS v
                FROM p JOIN t ON {on}),
      edges AS (SELECT pairs.*, th.thr FROM pairs JOIN {_THR} ON v >= th.t),
      {walk_sql(scope + ", candidate, page_id, label, thr", "score DESC, l, v DESC, r DESC")}"""


def _curve_sql(scope: str) -> str:
    group = f"{scope}, candidate, label"
    using = f"({group}, thr)"
    return _coco_sql(scope) + f""",
      npig AS (SELECT {scope}, label, count(*) AS n FROM t GROUP BY {scope}, label),
      ranked AS (SELECT {group}, page_id, det_id, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, page_id, det_id) AS pos FROM p),
      tp AS (SELECT {group}, thr, pos, row_number() OVER (PARTITION BY {group}, thr ORDER BY pos) AS k
             FROM (SELECT {group}, page_id, l AS det_id, thr FROM matched) m JOIN ranked USING ({group}, page_id, det_id)),
      tpn AS (SELECT tp.*, k::DOUBLE / n AS rc, k::DOUBLE / (pos + {K.COCO_EPS!r}::DOUBLE) AS pr FROM tp JOIN npig USING ({scope}, label)),
      axis AS (SELECT DISTINCT {group}, thr, i FROM npig JOIN (SELECT DISTINCT {scope}, candidate FROM p) USING ({scope}), range(0, 10) a(thr), range(0, 101) b(i)),
      best AS (SELECT {group}, thr, i, max(pr) AS v FROM axis JOIN tpn USING {using} WHERE rc >= i::DOUBLE * 0.01::DOUBLE GROUP BY {group}, thr, i),
      curve AS (SELECT {group}, thr, i, coalesce(v, 0.0::DOUBLE) AS prec FROM axis LEFT JOIN best USING ({group}, thr, i))"""


def _summary_sql(scope: str) -> str:
    return _curve_sql(scope) + f""",
      summary AS (SELECT {scope}, candidate, round(avg(prec), 5) AS map, round(avg(prec) FILTER (thr = 0), 5) AS map50, round(avg(prec) FILTER (thr = 5), 5) AS map75
                  FROM curve GROUP BY {scope}, candidate),
      sizes AS (SELECT {scope}, count(DISTINCT page_id) AS n_images, count(*) AS n_annotations FROM t GROUP BY {scope}),
      found AS (SELECT {scope}, candidate, count(*) AS n_detections FROM p0 GROUP BY {scope}, candidate),
      coco AS (SELECT * FROM summary JOIN sizes USING ({scope}) JOIN found USING ({scope}, candidate))"""


def _pr_sql(split: str, grid: list[float], scope: str) -> str:
    vals = ", ".join(f"({g}::DOUBLE)" for g in grid)
    on = " AND ".join(f"p.{c} = t.{c}" for c in [*scope.split(", "), "page_id", "label"])
    return f"""WITH RECURSIVE t AS (SELECT * FROM fx_truth WHERE split = '{split}'),
      p AS (SELECT * FROM fx_runs WHERE split = '{split}' AND ({scope}, page_id) IN (SELECT {scope}, page_id FROM t)),
      grid AS (SELECT * FROM (VALUES {vals}) AS g(threshold)),
      pairs AS (SELECT {", ".join("p." + c for c in scope.split(", "))}, p.candidate, p.page_id, p.label, t.box_id AS l, p.det_id AS r, p.score, {iou_sql('p.', 't.')} AS v FROM p JOIN t ON {on}),
      edges AS (SELECT pairs.*, threshold FROM pairs JOIN grid ON score >= threshold WHERE v >= 0.5::DOUBLE),
      {walk_sql(scope + ", candidate, page_id, label, threshold", "l, v DESC, r DESC")},
      hits AS (SELECT {scope}, candidate, threshold, count(*) AS tp FROM matched GROUP BY ALL),
      counted AS (SELECT {scope}, candidate, threshold, count(*) FILTER (score >= threshold) AS n_pred FROM p, grid GROUP BY ALL),
      wanted AS (SELECT {scope}, count(*) AS n_truth FROM t GROUP BY ALL),
      offered AS (SELECT * FROM (SELECT {scope} FROM wanted), grid, (VALUES ('candidate'), ('reference'), ('silent')) AS c(candidate)),
      pr AS (SELECT *, CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END AS precision, tp::DOUBLE / n_truth AS recall FROM
             (SELECT {scope}, candidate, threshold, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, n_truth FROM offered JOIN wanted USING ({scope})
              LEFT JOIN counted USING ({scope}, candidate, threshold) LEFT JOIN hits USING ({scope}, candidate, threshold)) x),
      f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
      best AS (SELECT {scope}, candidate, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {scope}, candidate ORDER BY f1 DESC, threshold) AS rn FROM f1) WHERE rn = 1)"""


def _agree_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE a AS ({a}), b AS ({b}),
  edges AS (SELECT * FROM (SELECT a.ws, a.dataset, a.page_id, a.label, a.det_id AS l, b.det_id AS r, {iou_sql('a.', 'b.')} AS v
            FROM a JOIN b ON a.ws = b.ws AND a.dataset = b.dataset AND a.page_id = b.page_id AND a.label = b.label) z WHERE v >= 0.9::DOUBLE),
  {walk_sql("ws, dataset, page_id, label", "v DESC, l DESC, r DESC")},
  mm AS (SELECT ws, dataset, page_id, count(*) AS matched FROM matched GROUP BY ALL),
  cc AS (SELECT ws, dataset, page_id, split, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b FROM
         (SELECT ws, dataset, page_id, split, 1 AS na, 0 AS nb FROM a UNION ALL SELECT ws, dataset, page_id, split, 0, 1 FROM b) z GROUP BY ALL),
  agree AS (SELECT ws, dataset, page_id, split, coalesce(matched, 0) AS matched, n_a, n_b, 2.0::DOUBLE * coalesce(matched, 0) / (n_a + n_b) AS agreement
            FROM cc LEFT JOIN mm USING (ws, dataset, page_id))"""


_AGREE = _agree_sql("SELECT * FROM fx_pred", "SELECT * FROM fx_ref")
_CHOSEN = _pr_sql("calib", K.F1_GRID, "ws, dataset") + " SELECT ws, threshold, f1 FROM best WHERE candidate = 'candidate' AND dataset = 'synth-clean'"
_FROZEN = "SELECT x.* FROM {} x JOIN chosen c ON c.ws = x.ws WHERE x.score >= c.threshold AND x.split = 'test' AND x.dataset = 'synth-clean'"
_EVALUATION = f"""WITH chosen AS MATERIALIZED ({_CHOSEN}),
  prs AS ({_pr_sql("test", K.F1_GRID, "ws, dataset")} SELECT ws, threshold, precision, recall FROM pr WHERE candidate = 'candidate' AND dataset = 'synth-clean'),
  maps AS MATERIALIZED ({_summary_sql("ws, dataset")} SELECT ws, dataset, candidate, map, map50 FROM coco),
  agreed AS ({_agree_sql(_FROZEN.format("fx_pred"), _FROZEN.format("fx_ref"))} SELECT ws, avg(coalesce(agreement, 1.0)) AS agreement
    FROM (SELECT DISTINCT ws, dataset, page_id FROM fx_truth WHERE split = 'test' AND dataset = 'synth-clean') t LEFT JOIN agree USING (ws, dataset, page_id) GROUP BY ws),
  one AS (SELECT ws, {", ".join(f"coalesce(max({m}) FILTER (dataset = '{ds}' AND candidate = '{who}'), 0) AS {name}_{who}{'_map50' if m == 'map50' else ''}"
                               for name, ds in (("clean", "synth-clean"), ("shift", "synth-scan")) for who in ("candidate", "reference") for m in ("map", "map50"))} FROM maps GROUP BY ws)
  SELECT ws, threshold AS operating_threshold, round(f1, 5) AS calib_f1, round(precision, 5) AS precision, round(recall, 5) AS recall, one.* EXCLUDE (ws),
    CASE WHEN ws <> 'w3' THEN round(agreement, 5) END AS agreement
  FROM chosen LEFT JOIN prs USING (ws, threshold) LEFT JOIN one USING (ws) LEFT JOIN agreed USING (ws)"""

_PAIRS = """pairs AS (SELECT w.ws, w.id, w.role, s.id AS shadow_item_id, pr.id AS primary_id, sr.id AS shadow_id,
    pr.detections AS pd, sr.detections AS sd
  FROM fx_item w LEFT JOIN fx_prediction pr ON pr.work_item_id = w.id AND pr.ws = w.ws AND pr.candidate_id = w.candidate_id
  LEFT JOIN fx_item s ON s.page_id = w.page_id AND s.ws = w.ws AND s.batch_id = w.batch_id AND s.role = 'shadow' AND s.candidate_id <> w.candidate_id
  LEFT JOIN fx_prediction sr ON sr.work_item_id = s.id AND sr.ws = w.ws AND sr.candidate_id = s.candidate_id)"""


def _dets(col: str, src: str) -> str:
    box = lambda i: f"CAST(json_extract(e, '$.box[{i}]') AS DOUBLE)"
    return f"""SELECT ws, id, shadow_item_id, pos, json_extract_string(e, '$.label') AS label, {box(0)} AS x1, {box(1)} AS y1, {box(2)} AS x2, {box(3)} AS y2
      FROM (SELECT ws, id, shadow_item_id, unnest(js) AS e, generate_subscripts(js, 1) - 1 AS pos FROM
             (SELECT ws, id, shadow_item_id, CAST(json_extract({col}, '$[*]') AS JSON[]) AS js FROM {src} WHERE json_valid({col})) y) z"""


_SHADOW = f"""WITH RECURSIVE {_PAIRS},
  live AS (SELECT * FROM pairs WHERE role = 'primary' AND shadow_id IS NOT NULL),
  b AS ({_dets('sd', 'live')}),
  a AS (SELECT * FROM ({_dets('pd', 'live')}) q WHERE (ws, id, shadow_item_id) IN (SELECT ws, id, shadow_item_id FROM b)),
  edges AS (SELECT * FROM (SELECT a.ws, a.id, a.shadow_item_id, a.pos AS l, b.pos AS r, {iou_sql('a.', 'b.')} AS v
            FROM a JOIN b ON a.ws = b.ws AND a.id = b.id AND a.shadow_item_id = b.shadow_item_id) z WHERE v >= 0.9::DOUBLE),
  {walk_sql("ws, id, shadow_item_id", "l, v DESC, r DESC")}"""

ORACLES = {k: oracle(v) for k, v in {
    "iou": f"""SELECT t.page_id, t.box_id, round({iou_sql('t.', 'p.')}, 9) AS iou FROM fx_truth t JOIN fx_pred p
               ON t.ws = p.ws AND t.page_id = p.page_id AND t.box_id = p.det_id""",
    "iou_pairs": f"""SELECT ws, label, count(*) AS n_50, count(*) FILTER (v >= 0.75::DOUBLE) AS n_75, round(avg(v), 6) AS mean_iou FROM
               (SELECT t.ws, t.label, {iou_sql('t.', 'p.')} AS v FROM fx_truth t JOIN fx_pred p ON t.ws = p.ws AND t.page_id = p.page_id AND t.label = p.label) z
               WHERE v >= 0.5::DOUBLE GROUP BY ws, label""",
    "cxcywh_to_xyxy": """SELECT page_id, q, round(cx - w / 2, 9) AS x1, round(cy - h / 2, 9) AS y1, round(cx + w / 2, 9) AS x2, round(cy + h / 2, 9) AS y2 FROM fx_box_query""",
    "sigmoid": f"SELECT page_id, pos, round({_SIG.format(_V)}, 9) AS score FROM fx_raw",
    "check_raw_outputs": """SELECT vec_id, CASE WHEN label = 3 THEN 'batch' ELSE 'queries' END AS reason FROM embeddings WHERE label = 3 OR vec_id % 10 = 0""",
    "topk_flat": f"WITH {_TOP} SELECT page_id, rank, pos, round(score, 9) AS score FROM top",
    "postprocess": f"""WITH {_TOP}, kept AS (SELECT *, CAST(FLOOR(pos / 8) AS BIGINT) AS q FROM top WHERE score > 0.30::DOUBLE)
        SELECT k.page_id, k.rank, {_LABELS} AS label, round(score, 9) AS score,
          round((cx - 0.5::DOUBLE * w) * scale_x + origin_x, 6) AS x1, round((cy - 0.5::DOUBLE * h) * scale_y + origin_y, 6) AS y1,
          round((cx + 0.5::DOUBLE * w) * scale_x + origin_x, 6) AS x2, round((cy + 0.5::DOUBLE * h) * scale_y + origin_y, 6) AS y2
        FROM kept k JOIN fx_box_query b ON k.page_id = b.page_id AND k.tile_id = b.tile_id AND k.q = b.q
        JOIN fx_tile t ON k.page_id = t.page_id AND k.tile_id = t.tile_id""",
    "tile_plan": """WITH m AS (SELECT id, width_px::BIGINT AS w, height_px::BIGINT AS h, greatest(width_px, height_px)::BIGINT AS g, round_even(greatest(width_px, height_px) * 0.15::DOUBLE, 0)::BIGINT AS o,
          (greatest(width_px, height_px) > 2200 OR greatest(width_px, height_px)::DOUBLE / least(width_px, height_px) > 1.6::DOUBLE) AS split FROM fx_page)
        SELECT id, 0::BIGINT AS tile_id, 0::BIGINT AS origin_x, 0::BIGINT AS origin_y, w AS tile_w, h AS tile_h FROM m WHERE NOT split
        UNION ALL SELECT id, 0, 0, 0, CASE WHEN w >= h THEN least(g // 2 + o, g) ELSE w END, CASE WHEN w >= h THEN h ELSE least(g // 2 + o, g) END FROM m WHERE split
        UNION ALL SELECT id, 1, CASE WHEN w >= h THEN g // 2 ELSE 0 END, CASE WHEN w >= h THEN 0 ELSE g // 2 END,
          CASE WHEN w >= h THEN g - g // 2 ELSE w END, CASE WHEN w >= h THEN h ELSE g - g // 2 END FROM m WHERE split""",
    "crowded_nms": _suppress_sql(f"SELECT {_PRED_COLS} FROM fx_crowd_pred") + " SELECT page_id, det_id, score FROM kept",
    "crowded_matches": f"""WITH RECURSIVE th AS (SELECT unnest([0.2, 0.6]::DOUBLE[]) AS threshold),
        likes AS (SELECT th.threshold, t.ws, t.page_id, t.label, t.box_id, list(p.det_id ORDER BY {iou_sql('t.', 'p.')} DESC, p.det_id DESC) AS likes
          FROM fx_crowd_truth t JOIN fx_crowd_pred p ON t.ws = p.ws AND t.page_id = p.page_id AND t.label = p.label JOIN th ON p.score >= th.threshold
          WHERE {iou_sql('t.', 'p.')} >= 0.5::DOUBLE GROUP BY ALL),
        lined AS (SELECT *, row_number() OVER (PARTITION BY threshold, ws, page_id, label ORDER BY box_id) AS i FROM likes),
        run AS (SELECT DISTINCT threshold, ws, page_id, label, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS used FROM lined
          UNION ALL SELECT r.threshold, r.ws, r.page_id, r.label, r.i + 1,
            CASE WHEN len(list_filter(m.likes, lambda x: NOT list_contains(r.used, x))) = 0 THEN r.used ELSE list_append(r.used, list_filter(m.likes, lambda x: NOT list_contains(r.used, x))[1]) END
          FROM run r JOIN lined m ON m.threshold = r.threshold AND m.ws = r.ws AND m.page_id = r.page_id AND m.label = r.label AND m.i = r.i + 1),
        tp AS (SELECT threshold, ws, sum(n)::BIGINT AS tp FROM (SELECT threshold, ws, page_id, label, max(len(used)) AS n FROM run GROUP BY ALL) z GROUP BY ALL)
        SELECT t.ws, th.threshold, coalesce(tp, 0) AS tp, (SELECT count(*) FROM fx_crowd_pred p WHERE p.ws = t.ws AND p.score >= th.threshold) AS n_pred, n_truth
        FROM (SELECT ws, count(*) AS n_truth FROM fx_crowd_truth GROUP BY ws) t CROSS JOIN th LEFT JOIN tp USING (threshold, ws)""",
    "nms": _suppress_sql(f"SELECT {_PRED_COLS} FROM fx_pred_all") + " SELECT page_id, det_id, score FROM kept",
    "merge_tiles": _suppress_sql(f"""SELECT {_PRED_COLS} FROM fx_pred_all UNION ALL
        SELECT ws, page_id, class_id, det_id + 1000000000000000, score * 0.5::DOUBLE, x1 + 3, y1, x2 + 3, y2 FROM fx_pred_all""") + """
        SELECT ws, count(*) AS kept, count(*) FILTER (det_id >= 1000000000000000) AS kept_second, sum(det_id)::DOUBLE AS id_sum FROM kept GROUP BY ws""",
    "raw_output_parity": """WITH u AS (SELECT label, v::DOUBLE AS a, v::DOUBLE + (pos % 7)::DOUBLE * 0.0001::DOUBLE AS b FROM
          (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) z)
        SELECT label, round(max(abs(a - b)), 8) AS max_abs_diff, round(avg(abs(a - b)), 8) AS mean_abs_diff,
          round(max(abs(a - b)) / max(abs(a)), 8) AS relative_diff, max(abs(a - b)) / max(abs(a)) <= 0.005::DOUBLE AS within_bound FROM u GROUP BY label""",
    "score_pages": """SELECT vec_id, pos % 8 AS class_id, round(sum(v::DOUBLE), 6) AS logit FROM
          (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) z GROUP BY vec_id, pos % 8""",
    "eval_inputs": """WITH t AS (SELECT ws, dataset, count(*) AS n_truth FROM fx_truth GROUP BY ALL)
        SELECT p.ws, p.dataset, p.candidate, count(*) AS n_pred, round(sum(score), 3) AS score_sum, any_value(n_truth) AS n_truth FROM fx_runs p JOIN t USING (ws, dataset)
        WHERE score >= 0.05::DOUBLE AND (p.ws, p.dataset, p.page_id) IN (SELECT ws, dataset, page_id FROM fx_truth) GROUP BY p.ws, p.dataset, p.candidate""",
    "coco_match": _coco_sql("ws, dataset") + " SELECT candidate, page_id, label, thr::BIGINT AS thr, l AS det_id, r AS box_id FROM matched",
    "pr_curve": _curve_sql("ws, dataset") + " SELECT ws, dataset, candidate, label, thr::BIGINT AS thr, i::BIGINT AS recall_point, round(prec, 9) AS precision FROM curve",
    "coco_map": _summary_sql("ws, dataset") + " SELECT * FROM coco",
    "class_ap": _curve_sql("ws, dataset") + " SELECT ws, dataset, candidate, label, round(avg(prec), 5) AS ap FROM curve GROUP BY ALL",
    "coco_empty": _summary_sql("ws, dataset") + """, ax AS (SELECT DISTINCT ws, dataset, candidate FROM fx_runs UNION SELECT DISTINCT ws, dataset, 'silent' FROM fx_runs WHERE candidate = 'reference')
        SELECT ws, dataset, candidate, coalesce(map, 0) AS map, coalesce(map50, 0) AS map50, coalesce(map75, 0) AS map75, coalesce(n_detections, 0) AS n_detections,
          CASE WHEN map IS NULL THEN 'nothing_detected' ELSE '' END AS note FROM ax LEFT JOIN coco USING (ws, dataset, candidate)""",
    "quality_table": _summary_sql("ws, dataset") + " SELECT ws, dataset, candidate, map, map50, n_images, n_annotations, n_detections FROM coco",
    "evaluation_row": _EVALUATION,
    "precision_recall": _pr_sql("test", [0.3], "ws, dataset") + " SELECT ws, dataset, candidate, tp, n_pred, n_truth, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr",
    "best_f1_threshold": _pr_sql("calib", K.F1_GRID, "ws, dataset") + " SELECT ws, dataset, candidate, threshold, round(f1, 6) AS f1 FROM best",
    "detection_agreement": _AGREE + " SELECT page_id, matched, n_a, n_b, round(agreement, 6) AS agreement FROM agree",
    "mean_agreement": _AGREE + """ SELECT ws, dataset, round(avg(coalesce(agreement, 1.0)), 6) AS agreement, count(*) AS n_pages
        FROM (SELECT DISTINCT ws, dataset, page_id FROM fx_truth WHERE split = 'test') t LEFT JOIN agree USING (ws, dataset, page_id) GROUP BY ws, dataset""",
    "shadow_pairs": f"WITH {_PAIRS} SELECT ws, id, shadow_item_id, primary_id IS NOT NULL AS has_primary, shadow_id IS NOT NULL AS has_shadow FROM pairs",
    "shadow_diff": _SHADOW + """,
        j AS (SELECT m.*, a.label AS la, b.label AS lb FROM matched m JOIN a ON a.ws = m.ws AND a.id = m.id AND a.shadow_item_id = m.shadow_item_id AND a.pos = m.l
              JOIN b ON b.ws = m.ws AND b.id = m.id AND b.shadow_item_id = m.shadow_item_id AND b.pos = m.r)
        SELECT ws, id, shadow_item_id, 'missing' AS kind, pos, label FROM a WHERE (ws, id, shadow_item_id, pos) NOT IN (SELECT ws, id, shadow_item_id, l FROM matched)
        UNION ALL SELECT ws, id, shadow_item_id, 'added', pos, label FROM b WHERE (ws, id, shadow_item_id, pos) NOT IN (SELECT ws, id, shadow_item_id, r FROM matched)
        UNION ALL SELECT ws, id, shadow_item_id, 'relabelled', l, concat(la, '->', lb) FROM j WHERE la <> lb""",
    "shadow_agreement": _SHADOW + """,
        n AS (SELECT ws, id, shadow_item_id, count(*) AS n FROM (SELECT ws, id, shadow_item_id FROM a UNION ALL SELECT ws, id, shadow_item_id FROM b) z GROUP BY ALL),
        mm AS (SELECT ws, id, shadow_item_id, count(*) AS matched FROM matched GROUP BY ALL)
        SELECT ws, id, shadow_item_id, coalesce(matched, 0) AS matched, round(2.0::DOUBLE * coalesce(matched, 0) / n, 4) AS agreement FROM n LEFT JOIN mm USING (ws, id, shadow_item_id)""",
    "class_ap_delta": """SELECT candidate, label, round(cand_ap, 6) AS candidate_ap, round(ref_ap, 6) AS reference_ap, round(cand_ap - ref_ap, 6) AS delta FROM fx_class_ap WHERE cand_ap IS NOT NULL""",
}.items()}
