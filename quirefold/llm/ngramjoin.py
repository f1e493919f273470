"""Join of near-equal documents: Jaccard of word-shingle sets at or above a threshold, exactly.

A set is hashed into ``GROUPS`` groups; its group counts are a point. For two sets the sum
of the smaller coordinates bounds their overlap from above, and so does the sum over the
upper corners of two boxes of points: an R-tree over points prunes pairs of boxes, then
pairs of points, and what survives is verified on the full sets.

One tree over a whole corpus would visit every pair of boxes of like size (two unrelated
documents lie within the radius that the threshold allows), so points are first dealt
into cells: documents that can link share one of the rarest ``n - ceil(t*n) + 1`` shingles
of both. Rarity comes from a table of ``2**RANK_BITS`` counters over all documents; any
fixed order is exact, a rare-first one keeps common passages out of the cells. Points have
two groups for every shingle (up to ``MOST_GROUPS``); the tree folds them to ``GROUPS``.

1. Equal sets become one class, its smallest id stands for it.
2. Each document of a cell is held against the cell's first one only; verified links give
   components. That is linear, and joins large groups of near copies.
3. In larger cells that still hold more than one component, the tree finds for each
   document its most promising partner in another one; again linear, again verified.
4. Cells that even then hold more than one component are searched in full for pairs across
   components: cells of a few points pair by pair, larger ones by the tree, in blocks of
   bounded size. Survivors of the bound are verified.

In a cell, a shingle at place p of a set of n leaves n - p for the overlap with a partner
whose first common shingle it is; pairs that cannot reach the threshold that way are left
to the cell of an earlier shingle.

The links found connect exactly what all links would connect. Shingles are 64-bit hashes.
Null and blank texts have an empty set and link with nothing; a text of fewer than ``k``
words is one shingle. A row with a null id links with nothing and has a null component.
Rows that repeat an id are judged by their own text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WordCache, by_batch, hold, offsets, small_batches, table
from quirefold.llm.components import components
from quirefold.session import materialize

K, PERCENT = 5, 80
GROUPS, MOST_GROUPS, RANK_BITS = 256, 65536, 21
#: Points of one block of a cell, and members of one verification group.
BLOCK, VERIFY = 1024, 512
#: Points of a cell that is searched pair by pair, children of a box, and pairs held at a time.
FEW, FANOUT, HELD = 64, 16, 1 << 18
#: Pairs of boxes whose bounds are taken at a time.
STRIDE = 1 << 12
#: Documents for each file of the small tables between steps.
DOCS_PER_FILE = 50_000
#: Bytes of text whose sets are made together.
TOGETHER = 1 << 20
#: Routes up to this number (16 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROUTES = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_SEEN = WordCache(xxhash.xxh3_64_intdigest, 100_000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], k: int = K) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes. bytes.lower and bytes.split follow the ASCII word rule."""
    hold("shingles", _SEEN.clear)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < TOGETHER or end == at):
            size += len(texts[end] or b"")
            end += 1
        split = [(t or b"").lower().split() for t in texts[at:end]]
        starts = offsets(np.array([len(w) for w in split], np.int64))
        h = np.fromiter(map(_SEEN.__getitem__, chain.from_iterable(split)), np.uint64, int(starts[-1]))
        rolled = h[: max(0, len(h) - k + 1)].copy()
        for j in range(1, k):
            rolled = rolled * _P + h[j : len(h) - k + 1 + j]
        rolled = _mix(rolled)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for word in h[a:b]:
                        whole = whole * _P + word
                yield _mix(np.array([whole], np.uint64))
            else:
                yield h[:0]
        at = end


def _shingle_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each counter occur, up to 65535: two bytes a counter, whatever the input."""
    slices = 16
    width = (1 << RANK_BITS) // slices

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), k):
                np.add.at(counts, (s >> np.uint64(64 - RANK_BITS)).astype(np.int64), 1)
        if counts.any():
            rows = np.minimum(counts, 65535).astype("<u2").reshape(slices, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices)), pa.array([r.tobytes() for r in rows], pa.binary())], ["slice", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[piece] = total.get(piece, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        if total:
            ranks = [np.minimum(v, 65535).astype("<u2").tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(ranks, pa.binary())], ["slice", "counts"])

    counts = docs.select("text").mapInArrow(counted, "slice bigint, counts binary")
    ranks = np.zeros((slices, width), np.uint16)
    for row in counts.repartition(slices, "slice").mapInArrow(summed, "slice bigint, counts binary").collect():
        ranks[row["slice"]] = np.frombuffer(row["counts"], "<u2")
    return ranks.ravel()


def _features(docs: DataFrame, ranks: np.ndarray, k: int, percent: int) -> DataFrame:
    """``doc_id, n, set_id, prefix, counts`` of every document."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, prefixes, counts = [], [], [], []
        for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), k):
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            rank = ranks[(s >> np.uint64(64 - RANK_BITS)).astype(np.int64)]
            order = np.argsort(rank, kind="stable")[:keep]
            prefixes.append(s[order].astype(np.int64))
            counts.append(_point(s).tobytes())
        flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
        ends = pa.array(offsets(np.array([len(p) for p in prefixes])).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(counts, pa.binary())],
            ["doc_id", "n", "set_id", "prefix", "counts"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), made, f"doc_id {kind}, n int, set_id binary, prefix array<bigint>, counts binary")


def _point(s: np.ndarray) -> np.ndarray:
    """Group counts in one byte each, 255 for more than 254; groups are a power of two, at least twice the shingles."""
    groups = GROUPS
    while groups < MOST_GROUPS and groups < 2 * len(s):
        groups *= 2
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def _folded(raw: bytes, groups: int = GROUPS) -> np.ndarray:
    """A point with fewer groups: groups are low bits of the hash, so every ``groups``-th count adds up.

    A count that did not fit is taken for a very large one, which keeps the bound a bound.
    """
    counts = np.frombuffer(raw, np.uint8).astype(np.int32)
    counts[counts == 255] = 1 << 20
    return counts.reshape(-1, groups).sum(axis=0)


def _cells(classes: DataFrame) -> DataFrame:
    """Cells of two documents or more: one row per document after the first, which it names."""
    rows = classes.select(F.posexplode("prefix").alias("place", "token"), "doc", "n").select("token", "doc", "n", "place")
    rows = rows.repartition("token").sortWithinPartitions("token", "doc")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, cols)]
            token = cols[0]
            start = np.concatenate([[True], token[1:] != token[:-1]])
            first = np.flatnonzero(start)[np.cumsum(start) - 1]
            later = np.flatnonzero(~start)
            held = [c[first[-1]] for c in cols]
            if len(later):
                both = [c[later] for c in cols] + [c[first[later]] for c in cols[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], ["token", "doc", "n", "place", "first", "first_n", "first_place"])

    return rows.mapInArrow(streamed, "token bigint, doc bigint, n int, place int, first bigint, first_n int, first_place int")


def _needed(a, b, percent: int):
    """Least overlap of sets of these sizes that reaches the threshold."""
    return -(-percent * (a.astype(np.int64) + b) // (100 + percent))


def _may_link(na, nb, pa_, pb, percent: int):
    """Whether sets of these sizes can link, with this shingle as their first common one."""
    need = _needed(na, nb, percent)
    return (na - pa_ >= need) & (nb - pb >= need) & (np.minimum(na, nb) >= need)


def _within_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose points allow the overlap they need."""
    points = classes.select("doc", "n", "counts")
    a = points.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    b = points.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = []
        for x, y in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist()):
            groups = min(len(x), len(y))
            shared.append(int(np.minimum(_folded(x, groups), _folded(y, groups)).sum()))
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        keep = np.array(shared) >= _needed(na, nb, percent)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return by_batch(pairs.join(a, "a").join(b, "b"), bounded, "a bigint, b bigint")


def _few_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs across components of small cells, sorted by token: all cells of a batch at once."""
    held: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, root, doc, n, place = cols
        edge = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
        ahead = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(token)) - 1
        upto = np.cumsum(ahead)
        at = 0
        while at < len(token):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD)))
            i = np.repeat(np.arange(at, end), ahead[at:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:end] - ahead[at:end] - (upto[at - 1] if at else 0), ahead[at:end])
            keep = (root[i] != root[j]) & _may_link(n[i], n[j], place[i], place[j], percent)
            found = np.unique(np.stack([np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j])], axis=1)[keep], axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            at = end

    for batch in batches:
        if batch.num_rows:
            cols = [c.to_numpy() for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[last:] for c in cols]
            if last:
                yield from pairs([c[:last] for c in cols])
    if held is not None:
        yield from pairs(held)


def tree_pairs(counts: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs of points in different groups that the overlap bound cannot rule out.

    The tree is packed bottom-up over the given order, ``FANOUT`` to a box; a box keeps its
    upper corner, its size range and its group (-1 when mixed). Pairs of boxes are refined
    level by level.
    """
    levels = [(counts, n.astype(np.int64), n.astype(np.int64), group)]
    while len(levels[-1][1]) > 1:
        top, low, high, own = levels[-1]
        cut = np.arange(0, len(low), FANOUT)
        same = np.minimum.reduceat(own, cut) == np.maximum.reduceat(own, cut)
        levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.where(same, own[cut], -1)))
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        top, low, high, own = levels[depth]
        if depth < len(levels) - 1:
            step = np.arange(FANOUT)
            i, j = (np.repeat(i * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(i)), np.repeat(j * FANOUT, FANOUT * FANOUT) + np.tile(step, len(j) * FANOUT))
            inside = (i < len(low)) & (j < len(low)) & ((i < j) if depth == 0 else (i <= j))
            i, j = i[inside], j[inside]
        kept_i, kept_j = [i[:0]], [j[:0]]
        for at in range(0, len(i), STRIDE):
            a, b = i[at : at + STRIDE], j[at : at + STRIDE]
            keep = ((own[a] != own[b]) | (own[a] == -1)) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            a, b = a[keep], b[keep]
            keep = np.minimum(top[a], top[b]).sum(axis=1) >= _needed(low[a], low[b], percent)
            kept_i.append(a[keep])
            kept_j.append(b[keep])
        i, j = np.concatenate(kept_i), np.concatenate(kept_j)
    keep = (i != j) & (group[i] != group[j])
    return np.stack([i[keep], j[keep]], axis=1)


def _open_cells(cells: DataFrame, roots: DataFrame, files: int) -> DataFrame:
    """Rows ``token, root, doc, n, place, size`` of cells that hold more than one component."""
    firsts = cells.select("token", F.col("first").alias("doc"), F.col("first_n").alias("n"), F.col("first_place").alias("place")).distinct()
    rows = cells.select("token", "doc", "n", "place").unionByName(firsts)
    placed = rows.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("token", F.coalesce("root", "doc").alias("root"), "doc", "n", "place")
    mixed = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    return materialize(placed.join(mixed.select("token", "size"), "token").repartition(files))


def _pair_by_pair(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in cells of a few points."""
    few = rows.where(F.col("size") <= FEW).select("token", "root", "doc", "n", "place").repartition("token").sortWithinPartitions("token", "root", "doc")
    return few.mapInArrow(lambda batches: _few_pairs(batches, percent), "a bigint, b bigint")


def _by_tree(rows: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs across components in larger cells; with ``best`` one for each point, the one with most overlap to spare."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    many = rows.where(F.col("size") > FEW).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("doc"), F.col("_blocks")).cast("int"))
    dealt = (
        many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("token", "doc", "root", "place", F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"))
        .join(classes.select("doc", "n", "counts"), "doc")
        .select("token", "bi", "bj", "root", "n", "place", "doc", "counts")
        .repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "root", "n", "doc")
    )

    def pairs(part: pa.Table) -> np.ndarray:
        n, root, place, doc = (part.column(c).to_numpy() for c in ("n", "root", "place", "doc"))
        points = np.stack([_folded(c) for c in part.column("counts").to_pylist()])
        i, j = tree_pairs(points, n, root, percent).T
        keep = _may_link(n[i], n[j], place[i], place[j], percent)
        i, j = i[keep], j[keep]
        if best and len(i):
            spare = np.concatenate([np.minimum(points[i[at : at + STRIDE]], points[j[at : at + STRIDE]]).sum(axis=1) for at in range(0, len(i), STRIDE)])
            spare -= _needed(n[i], n[j], percent)
            point, other, spare = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([spare, spare])
            order = np.lexsort((doc[other], -spare, point))
            first = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
            i, j = point[first], other[first]
        return np.stack([np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j])], axis=1)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found: list[np.ndarray] = []

        def drained() -> pa.RecordBatch:
            # a pair meets in many cells of its task
            both = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            keys = np.stack([now.column(c).to_numpy() for c in ("token", "bi", "bj")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:]):
                found.append(pairs(now.slice(a, b - a)))
                if sum(map(len, found)) > HELD:
                    yield drained()
            held = now.slice(edges[-1])
        if held is not None and held.num_rows:
            found.append(pairs(held))
        if found:
            yield drained()

    return dealt.mapInArrow(searched, "a bigint, b bigint")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, files: int) -> DataFrame:
    """Links ``u, v`` among the pairs ``a, b``: the sets meet in groups around ``b``."""
    pairs = materialize(pairs.repartition(files))
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / VERIFY).cast("int").alias("_parts"))
    dealt = pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int").alias("part"))
    routes = materialize(
        dealt.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "part", F.lit(1).alias("side"))
        .unionByName(dealt.select(F.col("b").alias("doc_id"), F.col("b").alias("centre"), "part", F.lit(0).alias("side")).distinct())
        .groupBy("doc_id").agg(F.collect_list(F.struct("centre", "part", "side")).alias("routes"), F.count("*").alias("_n"))
        .repartition(files)
    )
    total = routes.agg(F.sum("_n")).first()[0] or 0
    # ids can repeat with another text; the class keeps the set that is meant
    wanted = routes.select("doc_id", "routes").join(classes.select(F.col("doc").alias("doc_id"), "set_id"), "doc_id")
    wanted = F.broadcast(wanted) if total <= BROADCAST_ROUTES else wanted
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s.tobytes() for s in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)]
        fits = pa.array([xxhash.xxh3_128_digest(s) == w for s, w in zip(found, batch.column("set_id").to_pylist())])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("routes"), pa.array(found, pa.binary())], ["doc_id", "routes", "shingles"]).filter(fits)

    route = "array<struct<centre:bigint,part:int,side:int>>"
    sets = by_batch(chosen, made, f"doc_id bigint, routes {route}, shingles binary").select("doc_id", F.explode("routes").alias("r"), "shingles")
    met = sets.select("r.*", "doc_id", "shingles").repartition("centre", "part").sortWithinPartitions("centre", "part", "side", "doc_id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            u, v = [], []
            for b, part, side, doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(raw, np.uint64)
                if side == 0:
                    key, centre = (b, part), own
                elif key == (b, part):
                    at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    shared = int((centre[at] == own).sum())
                    if 100 * shared >= percent * (len(own) + len(centre) - shared):
                        u.append(doc)
                        v.append(b)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return materialize(met.mapInArrow(compared, "u bigint, v bigint").distinct().repartition(files))


def ngram_join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; ids are whole numbers."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return _joined(docs, k, percent)


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    features = materialize(_features(docs, _shingle_ranks(docs, k), k, percent))
    classes = materialize(
        features.where("set_id is not null and doc_id is not null").groupBy("set_id")
        .agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts"))
    )
    # what follows is far smaller than the documents; it is written by tasks in proportion, not by one for each shuffle partition
    files = max(8, -(-features.count() // DOCS_PER_FILE))
    cells = materialize(_cells(classes).repartition(files))
    need = F.ceil(percent * (F.col("n") + F.col("first_n")) / (100 + percent))
    fits = (F.col("n") - F.col("place") >= need) & (F.col("first_n") - F.col("first_place") >= need)
    near_first = cells.where(fits).select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()
    links = _verified(docs, classes, _within_bound(near_first, classes, percent), k, percent, files)
    roots = components(links, files)
    rows = _open_cells(cells, roots, files)
    if not rows.where(F.col("size") > FEW).isEmpty():
        best = _by_tree(rows, classes, percent, best=True).distinct()
        links = links.unionByName(_verified(docs, classes, _within_bound(best, classes, percent), k, percent, files))
        roots = components(links, files)
        rows = _open_cells(cells, roots, files)
    rest = _pair_by_pair(rows, percent).unionByName(_by_tree(rows, classes, percent, best=False)).distinct()
    links = links.unionByName(_verified(docs, classes, _within_bound(rest, classes, percent), k, percent, files))
    final = components(links, files)
    of_class = classes.select("set_id", "doc").join(final, F.col("doc") == F.col("node"), "left").select("set_id", F.coalesce("root", "doc").alias("_component"))
    linked = features.select("doc_id", "n", "set_id").join(of_class, "set_id", "left")
    return linked.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
    )


def op9_ngramjoin(spark, sf_dir) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingles from words),
sizes as (select doc_id, cast(len(shingles) as bigint) as n from sets),
flat as (select doc_id, unnest(shingles) as s from sets),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k from flat a join flat b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select u, v from links union all select v, u from links),
reach as (select doc_id as u, doc_id as v from documents union select r.u, b.v from reach r join both_ways b on b.u = r.v)
select s.doc_id, s.n as n_shingles, m.component_id from sizes s join (select u, min(v) as component_id from reach group by u) m on m.u = s.doc_id
"""
