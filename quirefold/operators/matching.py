"""One-to-one box matching and suppression, exact for pages of any size.

Three facts shape this module:

* Candidate pairs always share an equality key (page, often also class), so small
  groups are a plain equi-join with the overlap as a residual condition, folded inside
  the JVM.
* Every greedy matcher used here is the same thing: walk the candidate pairs in a
  total order and take a pair when both ends are free.
* That walk never looks beyond a connected component of the overlap graph. Groups above
  ``FOLD_BOXES`` are cut into components and each is walked on its own. Equal boxes are
  one vertex of the graph with its boxes in order, so a page of copies has as many pairs
  as it has different boxes that overlap. Candidate pairs come from a grid whose cell
  size follows the box size, so no group is ever paired with itself wholesale. The
  number of jobs does not depend on how long a chain of ties is; a task holds the
  vertices and edges of one component.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.geometry import CORNERS, corners, fields, has_area, iou
from quirefold.operators.components import components
from quirefold.operators.ordering import oversize_groups
from quirefold.session import materialize

FOLD_BOXES = 256
#: Levels that a bit mask has room for.
MASK_STEPS = 62


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def _level(low: str, high: str) -> Column:
    return F.floor(F.log2(F.col(high) - F.col(low)))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level + 1))


def _gridded(left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float) -> DataFrame:
    """Overlapping pairs of hot groups.

    Two boxes with overlap ``t`` differ by at most ``ceil(log2(1/t))`` size levels
    per axis and share the cell that holds the corner of their intersection, at the
    left box's level. Testing for that one cell keeps each pair once.
    """
    reach = max(1, math.ceil(math.log2(1.0 / min_iou)))
    for axis, (lo, hi) in {"x": ("x1", "x2"), "y": ("y1", "y2")}.items():
        lvl, cell = f"_k{axis}", f"_c{axis}"
        left = left.withColumn(lvl, _level(f"l_{lo}", f"l_{hi}")).withColumn(
            cell, F.explode(F.sequence(_cell(F.col(f"l_{lo}"), F.col(lvl)), _cell(F.col(f"l_{hi}"), F.col(lvl))))
        )
        right = right.withColumn(
            lvl, F.explode(F.sequence(_level(f"r_{lo}", f"r_{hi}") - reach, _level(f"r_{lo}", f"r_{hi}") + reach))
        ).withColumn(
            cell, F.explode(F.sequence(_cell(F.col(f"r_{lo}"), F.col(lvl)), _cell(F.col(f"r_{hi}"), F.col(lvl))))
        )
    pairs = left.join(right, [*keys, "_kx", "_cx", "_ky", "_cy"])
    home = (_cell(F.greatest("l_x1", "r_x1"), F.col("_kx")) == F.col("_cx")) & (
        _cell(F.greatest("l_y1", "r_y1"), F.col("_ky")) == F.col("_cy")
    )
    return pairs.where(home).drop("_kx", "_cx", "_ky", "_cy")


def hot_groups(keys: Sequence[str], limit: int, *sides: DataFrame) -> DataFrame | None:
    rows = sides[0].select(*keys)
    for other in sides[1:]:
        rows = rows.unionByName(other.select(*keys))
    return oversize_groups(rows, keys, limit)


def _hot_by_candidate(keys: Sequence[str], limit: int, left: DataFrame, right: DataFrame, candidate: str) -> DataFrame | None:
    """Groups with more than half of ``limit`` boxes on the left, or of any one candidate on the right.

    Each candidate is matched on its own, so how many of them share a page does not count.
    """
    rows = left.select(*keys, F.lit(None).cast("string").alias("_c")).unionByName(right.select(*keys, F.col(candidate).cast("string").alias("_c")))
    hot = oversize_groups(rows, [*keys, "_c"], limit // 2)
    return None if hot is None else hot.select(*keys).distinct()


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    min_iou: float,
    strict: bool = False,
    where: Column | None = None,
    limit: int = FOLD_BOXES,
    hot: DataFrame | None | str = "measure",
) -> tuple[DataFrame, DataFrame | None]:
    """Pairs with overlap at least ``min_iou`` as (pairs of small groups, pairs of hot groups).

    Columns other than the keys get the prefixes ``l_`` and ``r_``; ``iou`` is added.
    """
    left, right = left.where(has_area()), right.where(has_area())
    if isinstance(hot, str):
        hot = hot_groups(keys, limit, left, right)
    (calm_l, calm_r), warm = _split(left, right, keys, hot)
    calm = _finished(_joined(calm_l, calm_r, keys), min_iou, strict, where)
    if warm is None:
        return calm, None
    return calm, _finished(_gridded(_renamed(warm[0], keys, "l_"), _renamed(warm[1], keys, "r_"), keys, min_iou), min_iou, strict, where)


def _split(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Both sides of small groups, and both sides of hot ones if there are any."""
    if hot is None:
        return (left, right), None
    calm, warm = ([side.join(hot, list(keys), how) for side in (left, right)] for how in ("left_anti", "left_semi"))
    return tuple(calm), tuple(warm)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    # a merge join leaves rows partitioned by the keys, which the walk then reuses
    return _renamed(left, keys, "l_").join(_renamed(right, keys, "r_").hint("merge"), list(keys))


def _finished(pairs: DataFrame, min_iou: float, strict: bool = False, where: Column | None = None) -> DataFrame:
    if where is not None:
        pairs = pairs.where(where)
    pairs = pairs.withColumn("iou", iou(corners("l_"), corners("r_")))
    return pairs.where(F.col("iou") > min_iou if strict else F.col("iou") >= min_iou)


@dataclass(frozen=True)
class Levels:
    """Several thresholds judged over the same pairs.

    ``steps`` maps the emitted value to its bound; a pair passes when its column ``on`` (the
    overlap, or one of the right side) reaches the bound. ``on`` must be kept. With ``mask``
    (up to ``MASK_STEPS`` steps) the emitted value is a number in which bit i stands for step i
    in place of a row for each step; a pair may still come in several rows, each bit once.
    """

    name: str
    steps: Sequence[tuple[object, float]]
    on: str
    mask: bool = False


def _test(levels: Levels, bound: float) -> Callable[[Column], Column]:
    return lambda entry: entry[levels.on] >= F.lit(bound)


def _walk(entries: Column) -> Column:
    """Take each entry, in order, whose two ends are free."""

    def taken(pairs: Column) -> Column:
        folded = F.aggregate(
            pairs,
            F.slice(pairs, 1, 0),
            lambda acc, e: F.when(
                F.exists(acc, lambda m: (m["_l"] == e["_l"]) | (m["_r"] == e["_r"])), acc
            ).otherwise(F.concat(acc, F.array(e))),
        )
        return F.when(F.size(pairs) <= 1, pairs).otherwise(folded)

    # binding the array to a lambda variable evaluates it once
    return F.transform(F.array(entries), taken)[0]


def _walk_small(
    pairs: DataFrame, keys: Sequence[str], l: str, r: str, order: Sequence[Column], keep: Sequence[str], levels: Levels | None
) -> DataFrame:
    entry = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        F.col(l).alias("_l"), F.col(r).alias("_r"), *[F.col(c) for c in keep],
    )
    grouped = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_pairs"))
    out = [F.col("_m._l").alias(l), F.col("_m._r").alias(r), *[F.col(f"_m.{c}").alias(c) for c in keep]]
    if levels is None:
        return grouped.select(*keys, F.explode(_walk(F.col("_pairs"))).alias("_m")).select(*keys, *out)
    if levels.mask:
        row = lambda e, bits: F.struct(bits.alias("_bits"), e["_l"].alias("_l"), e["_r"].alias("_r"), *[e[c].alias(c) for c in keep])
        bit = lambda i: F.lit(1 << i).cast("bigint")
        step = lambda i: F.transform(_walk(F.filter("_pairs", _test(levels, levels.steps[i][1]))), lambda e: row(e, bit(i)))
        # from the entry: over the joined rows the overlap would be worked out again for every level
        passed = lambda e: reduce(lambda a, b: a.bitwiseOR(b), [F.when(e[levels.on] >= F.lit(b), bit(i)).otherwise(F.lit(0).cast("bigint")) for i, (_, b) in enumerate(levels.steps)])
        walked = F.concat(*[step(i) for i in range(len(levels.steps))])
        # where no box is in two pairs, nothing is in the way at any level
        apart = lambda end: F.size(F.array_distinct(F.transform("_pairs", lambda e: e[end]))) == F.size("_pairs")
        alone = (F.size("_pairs") <= 1) | (apart("_l") & apart("_r"))
        found = F.when(alone, F.transform("_pairs", lambda e: row(e, passed(e)))).otherwise(walked)
        # unnested from an array of one: Spark filters on the size of what is unnested, and would compute it again for that
        one = grouped.select(*keys, F.explode(F.array(F.struct(found.alias("_ms")))).alias("_e"))
        return one.select(*keys, F.explode("_e._ms").alias("_m")).where("_m._bits <> 0").select(*keys, F.col("_m._bits").alias(levels.name), *out)
    each = F.array(*[
        F.struct(
            F.lit(value).alias(levels.name),
            _walk(F.filter("_pairs", _test(levels, bound))).alias("_ms"),
        )
        for value, bound in levels.steps
    ])
    return (
        grouped.select(*keys, F.explode(each).alias("_e"))
        .select(*keys, F.col(f"_e.{levels.name}").alias(levels.name), F.explode("_e._ms").alias("_m"))
        .select(*keys, levels.name, *out)
    )


def _vertex(side: str, own: Sequence[str], prefix: str) -> Column:
    """Name of a box: equal boxes of a group (and candidate) have the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [*own, *[prefix + c for c in CORNERS]]]
    return F.md5(F.concat_ws("|", F.lit(side), *parts).cast("binary"))


def _choices(edges: list[tuple[float, str]], head: Callable[[str], int | None]) -> list[list[tuple[int, str]]]:
    """Right vertices by overlap, the best last; equal overlaps as a heap by their first free box."""
    out = []
    for _, same in groupby(sorted(edges), key=lambda e: e[0]):
        heap = [(head(v), v) for _, v in same if head(v) is not None]
        heapq.heapify(heap)
        out.append(heap)
    return out


def walk_component(
    edges: list[tuple[str, str, float]], lefts: list[str], rights: list[str], overlap_first: bool
) -> Iterator[tuple[int, int, float]]:
    """Taken pairs as (left box, right box, overlap) of one component.

    ``lefts`` and ``rights`` name the vertex of each box, in the order in which boxes choose
    and are chosen. Lefts choose their best overlap one by one; with ``overlap_first`` all
    pairs of one overlap come before all of the next lower one.
    """
    boxes_l, boxes_r = {}, {}
    for boxes, side in ((boxes_l, lefts), (boxes_r, rights)):
        for n, vertex in enumerate(side):
            boxes.setdefault(vertex, []).append(n)
    at_l, at_r = dict.fromkeys(boxes_l, 0), dict.fromkeys(boxes_r, 0)

    def first(boxes: dict[str, list[int]], at: dict[str, int], vertex: str) -> int | None:
        return boxes[vertex][at[vertex]] if vertex in at and at[vertex] < len(boxes[vertex]) else None

    head = lambda v: first(boxes_r, at_r, v)
    edges = sorted(edges, key=lambda e: -e[2])
    for _, same in groupby(edges, key=lambda e: e[2] if overlap_first else None):
        of_left: dict[str, list[tuple[float, str]]] = {}
        for u, v, overlap in same:
            of_left.setdefault(u, []).append((overlap, v))
        known = {u: {v: o for o, v in some} for u, some in of_left.items()}
        choices = {u: _choices(some, head) for u, some in of_left.items()}
        queue = [(n, u) for u in of_left if (n := first(boxes_l, at_l, u)) is not None]
        heapq.heapify(queue)
        while queue:
            n, u = heapq.heappop(queue)
            groups, taken = choices[u], None
            while groups and taken is None:
                if not groups[-1]:
                    groups.pop()
                    continue
                rank, v = groups[-1][0]
                now = head(v)
                if now is None:
                    heapq.heappop(groups[-1])
                elif now != rank:
                    heapq.heapreplace(groups[-1], (now, v))
                else:
                    taken = v
            # nothing becomes free again, so the other boxes of this vertex would find nothing either
            if taken is None:
                continue
            yield n, head(taken), known[u][taken]
            at_r[taken] += 1
            at_l[u] += 1
            if (n := first(boxes_l, at_l, u)) is not None:
                heapq.heappush(queue, (n, u))


def _by_component(df: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``work`` on the rows of each component, which lie together and in order in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            names, start = batch.column("component").to_pylist(), 0
            while start < len(names):
                end = start
                while end < len(names) and names[end] == names[start]:
                    end += 1
                if names[start] != name and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                name = names[start]
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.mapInArrow(run, schema)


def _walk_crowded(
    left: DataFrame, right: DataFrame, keys: Sequence[str], l: str, r: str, min_iou: float, left_order: Sequence[Column], right_order: Sequence[Column],
    overlap_first: bool, keep: Sequence[str], levels: Levels | None, candidate: str | None,
) -> DataFrame:
    """The walk over hot groups, component by component; both sides carry their prefixes."""
    own = {p: [*keys, *([candidate] if candidate and candidate.startswith(p) else [])] for p in ("l_", "r_")}
    boxes = {p: side.withColumn(f"{p}v", _vertex(p, own[p], p)) for p, side in (("l_", left), ("r_", right))}
    folded = {p: boxes[p].select(*own[p], f"{p}v", *corners(p)).distinct() for p in boxes}
    # one graph per candidate: a vertex of the other side counts in each
    split = F.coalesce(F.col(candidate).cast("string"), F.lit("~")) if candidate else F.lit("")
    pairs = materialize(
        _finished(_gridded(folded["l_"], folded["r_"], keys, min_iou), min_iou)
        .select(*keys, "l_v", "r_v", "iou", F.floor("l_y1").alias("_at"), *[F.md5(F.concat_ws("|", f"{p}v", split).cast("binary")).alias(f"{p}u") for p in boxes])
    )
    found = materialize(components(pairs, "l_u", "r_u", [*[F.col(k) for k in keys], F.col("_at")]))
    of = lambda p: pairs.select(f"{p}v", F.col(f"{p}u").alias("vertex")).distinct().join(found, "vertex").select(f"{p}v", "component")
    orders = [("l_", o, f"_l{i}") for i, o in enumerate(left_order)] + [("r_", o, f"_r{i}") for i, o in enumerate(right_order)]
    kept = {p: [c for c in keep if c.startswith(p)] for p in boxes}
    wanted = {"l_": [*keys, *([candidate] if candidate else []), l, *kept["l_"]], "r_": [r, *kept["r_"]]}
    if candidate in own["r_"]:
        wanted["l_"].remove(candidate)
        wanted["r_"].append(candidate)

    def rows(kind: int, frame: DataFrame, p: str) -> DataFrame:
        return frame.select(
            "component", F.lit(kind).alias("kind"), F.col(f"{p}v").alias("v"), *[o.alias(n) for side, o, n in orders if side == p], *wanted[p]
        )

    edges = pairs.join(found, pairs["l_u"] == found["vertex"]).select("component", F.lit(0).alias("kind"), F.col("l_v").alias("v"), F.col("r_v").alias("w"), "iou")
    all_rows = edges
    for kind, p in ((1, "l_"), (2, "r_")):
        all_rows = all_rows.unionByName(rows(kind, boxes[p].join(of(p), f"{p}v"), p), allowMissingColumns=True)
    in_order = all_rows.repartition("component").sortWithinPartitions("component", "kind", *[n for _, _, n in orders])
    out = [*wanted["l_"], *wanted["r_"]]
    schema = T.StructType([in_order.schema[c] for c in out] + [T.StructField("iou", T.DoubleType()), T.StructField("_level", T.IntegerType())])
    steps = None if levels is None else [b for _, b in levels.steps]
    on = None if levels is None else levels.on

    def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = table.column("kind").to_pylist()
        n_edges, n_left = kinds.count(0), kinds.count(1)
        part = lambda c, a, n: table.column(c).slice(a, n).to_pylist()
        graph = list(zip(part("v", 0, n_edges), part("w", 0, n_edges), part("iou", 0, n_edges)))
        lefts = part("v", n_edges, n_left)
        rights = part("v", n_edges + n_left, None)
        values = part(on, n_edges + n_left, None) if on not in (None, "iou") else None
        for level, bound in enumerate([None] if steps is None else steps):
            some = graph if bound is None or values is not None else [e for e in graph if e[2] >= bound]
            index = [i for i, v in enumerate(values) if v is not None and v >= bound] if values is not None else range(len(rights))
            taken = list(walk_component(some, lefts, [rights[i] for i in index], overlap_first))
            if not taken:
                continue
            at_l = pa.array([n_edges + n for n, _, _ in taken])
            at_r = pa.array([n_edges + n_left + index[n] for _, n, _ in taken])
            columns = [table.column(c).combine_chunks().take(at_l if c in wanted["l_"] else at_r) for c in out]
            columns += [pa.array([o for _, _, o in taken], pa.float64()), pa.array([level] * len(taken), pa.int32())]
            yield from pa.table(columns, names=[*out, "iou", "_level"]).to_batches()

    matched = _by_component(in_order, walked, schema)
    if levels is not None and levels.mask:
        matched = matched.withColumn(levels.name, F.expr("shiftleft(1L, _level)"))
    elif levels is not None:
        matched = matched.withColumn(levels.name, F.element_at(F.array(*[F.lit(v) for v, _ in levels.steps]), F.col("_level") + 1))
    named = [F.col(candidate).alias("candidate")] if candidate else []
    return matched.select(*keys, *named, *([levels.name] if levels else []), l, r, *keep)


def match_boxes(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l: str,
    r: str,
    min_iou: float,
    left_order: Sequence[Column],
    right_order: Sequence[Column],
    overlap_first: bool = False,
    keep: Sequence[str] = (),
    levels: Levels | None = None,
    candidate: str | None = None,
    limit: int = FOLD_BOXES,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Walk overlapping pairs in order and take each one whose two ends are free.

    Lefts choose in ``left_order``, each its greatest overlap and then the first right in
    ``right_order``; with ``overlap_first`` the overlap comes before both orders. Columns
    other than the keys have the prefixes ``l_`` and ``r_``; ``candidate`` names one that
    splits the groups further. ``sized_by`` names the side whose group sizes decide, when
    the other is bounded already.
    """
    left, right = left.where(has_area()), right.where(has_area())
    if candidate is not None and sized_by is None:
        hot = _hot_by_candidate(keys, limit, left, right, candidate.removeprefix("r_"))
    else:
        hot = hot_groups(keys, limit, *([left, right] if sized_by is None else [sized_by]))
    (calm_l, calm_r), warm = _split(left, right, keys, hot)
    calm, groups = _finished(_joined(calm_l, calm_r, keys), min_iou), list(keys)
    if candidate is not None:
        calm, groups = calm.withColumnRenamed(candidate, "candidate"), [*keys, "candidate"]
    overlap = -F.col("iou")
    order = [overlap, *left_order, *right_order] if overlap_first else [*left_order, overlap, *right_order]
    matched = _walk_small(calm, groups, l, r, order, keep, levels)
    if warm is None:
        return matched
    sides = [_renamed(side, keys, p) for side, p in zip(warm, ("l_", "r_"))]
    return matched.unionByName(_walk_crowded(*sides, keys, l, r, min_iou, left_order, right_order, overlap_first, keep, levels, candidate))


def suppress(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column], ident: str, max_iou: float, limit: int = FOLD_BOXES) -> DataFrame:
    """Greedy suppression: in ``order``, keep a box unless a kept one overlaps it by more than ``max_iou``.

    Exact copies of a box share its fate or are removed by it, so only the first copy
    takes part; that bounds the work when one box is repeated without limit. Boxes
    without area overlap nothing and are always kept.
    """
    flat = boxes.where(~has_area())
    solid = boxes.where(has_area())
    cols = boxes.columns
    names = [f"_o{i}" for i in range(len(order))]
    ranked = solid.select("*", *[o.alias(n) for o, n in zip(order, names)])
    rest = [c for c in cols if c not in keys and c not in ("x1", "y1", "x2", "y2")]
    unique = (
        ranked.groupBy(*keys, "x1", "y1", "x2", "y2")
        .agg(F.min(F.struct(*names, *rest)).alias("_s"))
        .select(*keys, "x1", "y1", "x2", "y2", "_s.*")
    )
    hot = oversize_groups(solid, keys, limit)
    if hot is not None:
        unique = materialize(unique)
    small = unique if hot is None else unique.join(hot, list(keys), "left_anti")
    kept = F.aggregate(
        "_boxes",
        F.filter("_boxes", lambda _: F.lit(False)),
        lambda acc, b: F.when(
            F.exists(acc, lambda k: iou(fields(k), fields(b)) > max_iou), acc
        ).otherwise(F.concat(acc, F.array(b))),
    )
    entry = F.struct(*names, *[c for c in cols if c not in keys])
    out = (
        small.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_boxes"))
        .select(*keys, F.explode(kept).alias("_k"))
        .select(*[F.col(c) if c in keys else F.col(f"_k.{c}").alias(c) for c in cols])
    )
    if hot is not None:
        out = out.unionByName(_suppress_crowded(unique.join(hot, list(keys), "left_semi"), keys, names, max_iou, limit).select(*cols))
    return out.unionByName(flat.select(*cols))


def _suppress_crowded(boxes: DataFrame, keys: Sequence[str], names: Sequence[str], max_iou: float, limit: int) -> DataFrame:
    """Per component of the overlap graph: in order, a box that is still there removes its weaker neighbours."""
    boxes = materialize(boxes.withColumn("_v", _vertex("", keys, "")))
    side = boxes.select(*keys, "_v", *names, *CORNERS)
    rank_l, rank_r = F.struct(*[f"l_{n}" for n in names]), F.struct(*[f"r_{n}" for n in names])
    groups = boxes.select(*keys).distinct()
    _, pairs = overlapping_pairs(side, side, keys, max_iou, strict=True, where=rank_l < rank_r, limit=limit, hot=groups)
    edges = materialize(pairs.select(*keys, F.col("l__v").alias("v"), F.col("r__v").alias("w"), F.floor("l_y1").alias("_at")))
    found = materialize(components(edges, "v", "w", [*[F.col(k) for k in keys], F.col("_at")]))
    rows = edges.join(found, edges["v"] == found["vertex"]).select("component", F.lit(0).alias("kind"), "v", "w").unionByName(
        boxes.join(found, boxes["_v"] == found["vertex"]).select("component", F.lit(1).alias("kind"), F.col("_v").alias("v"), *names), allowMissingColumns=True
    )
    in_order = rows.repartition("component").sortWithinPartitions("component", "kind", *names)

    def removed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        weaker, lost = {}, set()
        for kind, v, w in zip(*[table.column(c).to_pylist() for c in ("kind", "v", "w")]):
            if kind == 0:
                weaker.setdefault(v, []).append(w)
            elif v not in lost:
                lost.update(weaker.get(v, ()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(lost), pa.string())], ["_v"])

    lost = _by_component(in_order, removed, T.StructType([T.StructField("_v", T.StringType())]))
    return boxes.join(lost, "_v", "left_anti")
