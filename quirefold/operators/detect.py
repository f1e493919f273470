"""From raw model tensors to page-pixel detections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold import constants as K
from quirefold.functions.geometry import centre_to_corners, corners, iou, sigmoid
from quirefold.operators.matching import suppress


def paired_iou(pairs: DataFrame, a: str = "a_", b: str = "b_", name: str = "iou") -> DataFrame:
    return pairs.withColumn(name, iou(corners(a), corners(b)))


def corners_from_centres(boxes: DataFrame) -> DataFrame:
    made = centre_to_corners(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    return boxes.withColumns(dict(zip(("x1", "y1", "x2", "y2"), made)))


def shape_violations(raw: DataFrame, items: str = "n_items", batch: str = "n_batch") -> DataFrame:
    """Rows whose declared batch or query dimension disagrees with the arrays."""
    reason = F.when(F.col(items) != F.col(batch), F.lit("batch")).when(
        F.size("boxes") != F.size("logits"), F.lit("queries")
    )
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def top_scores(logits: DataFrame, k: int, keys: Sequence[str] = ("page_id", "tile_id")) -> DataFrame:
    """The ``k`` best entries of each flattened query-by-class matrix.

    One query may contribute several classes. The rank filter is pushed below the
    shuffle, so each map task sends at most ``k`` rows per tile.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("v"), F.asc("pos"))
    return (
        logits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("score", sigmoid(F.col("v")))
    )


def postprocess(
    logits: DataFrame,
    boxes: DataFrame,
    tiles: DataFrame,
    labels: Mapping[int, str],
    n_queries: int,
    n_classes: int,
    threshold: float = K.SCORE_THRESHOLD,
    top_k: int | None = None,
) -> DataFrame:
    """Score, threshold (strictly), label and scale; no clipping and no rounding."""
    k = n_queries if top_k is None else min(top_k, n_queries * n_classes)
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    class_id = (F.col("pos") % n_classes).cast("int")
    kept = (
        top_scores(logits, k)
        .where(F.col("score") > threshold)
        .select("page_id", "tile_id", "rank", "score", class_id.alias("class_id"),
                F.floor(F.col("pos") / n_classes).cast("int").alias("q"))
    )
    placed = kept.join(corners_from_centres(boxes).select("page_id", "tile_id", "q", "x1", "y1", "x2", "y2"),
                       ["page_id", "tile_id", "q"]).join(tiles, ["page_id", "tile_id"])
    return placed.select(
        "page_id", "tile_id", "rank", "class_id",
        F.coalesce(F.try_element_at(known, F.col("class_id")), F.concat(F.lit("class_"), F.col("class_id"))).alias("label"),
        "score",
        *[(F.col(c) * F.col(f"scale_{c[0]}") + F.col(f"origin_{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


def tile_plan(
    pages: DataFrame,
    long_side: int = K.TILE_LONG_SIDE,
    aspect: float = K.TILE_ASPECT,
    overlap: float = K.TILE_OVERLAP,
) -> DataFrame:
    """One region per page, or two overlapping ones along the long axis."""
    w, h = F.col("width_px"), F.col("height_px")
    longest = F.greatest(w, h)
    extra = F.rint(longest * F.lit(overlap)).cast("int")
    across = w >= h
    half = F.floor(longest / 2).cast("int")

    def region(no: int, start, length):
        return F.struct(
            F.lit(no).alias("tile_id"),
            F.when(across, start).otherwise(0).cast("int").alias("origin_x"),
            F.when(across, 0).otherwise(start).cast("int").alias("origin_y"),
            F.when(across, length).otherwise(w).cast("int").alias("tile_w"),
            F.when(across, h).otherwise(length).cast("int").alias("tile_h"),
        )

    whole = F.array(region(0, F.lit(0), longest))
    halves = F.array(region(0, F.lit(0), F.least(half + extra, longest)), region(1, half, longest - half))
    split = (longest > long_side) | (longest / F.greatest(F.lit(1), F.least(w, h)) > aspect)
    return pages.select("*", F.explode(F.when(split, halves).otherwise(whole)).alias("_t")).select(*pages.columns, "_t.*")


def merge_tiles(
    detections: DataFrame,
    page_keys: Sequence[str] = ("ws", "page_id"),
    class_col: str = "class_id",
    ident: str = "det_id",
    max_iou: float = K.NMS_IOU,
    limit: int | None = None,
) -> DataFrame:
    """Class-wise greedy suppression of boxes seen twice across a tile seam."""
    kwargs = {} if limit is None else {"limit": limit}
    return suppress(detections, [*page_keys, class_col], [-F.col("score"), F.col(ident)], ident, max_iou, **kwargs)


def tensor_diff(frame: DataFrame, a: str, b: str, by: Sequence[str] = (), bound: float = K.LOGIT_RELATIVE_BOUND) -> DataFrame:
    """Largest and mean absolute difference of two aligned arrays, and the relative verdict."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    rows = frame.select(
        *by,
        F.array_max(gap).alias("_m"),
        F.aggregate(gap, F.lit(0.0), lambda s, x: s + x).alias("_s"),
        F.size(gap).alias("_n"),
        F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))).alias("_a"),
    )
    return rows.groupBy(*by).agg(
        F.max("_m").alias("max_abs_diff"),
        (F.sum("_s") / F.sum("_n")).alias("mean_abs_diff"),
        (F.max("_m") / F.max("_a")).alias("relative_diff"),
    ).withColumn("within_bound", F.col("relative_diff") <= bound)


def score_pages(pages: DataFrame, make_predict_fn: Callable, tensor: str, shape: Sequence[int], batch_size: int = K.MAX_BATCH) -> DataFrame:
    """Run a pinned model over pages in small batches; it is loaded once per Python worker."""
    model = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    return pages.withColumn("logits", model(tensor))
