"""Nearest neighbours by learned partitions of the vector space.

On a sample of at most ``SAMPLE`` vectors (those with the smallest id hash) the exact
neighbour graph is cut into balanced parts that keep neighbours together, and a small
network learns which parts hold a vector's neighbours. Every vector is indexed under its
most probable part; a query visits its most probable parts until their probability
reaches ``MASS``, and the rows there are reranked by exact distance.

The number of parts follows the number of vectors, up to ``MAX_PARTS``. Parts are dealt in
blocks of bounded size, rows and queries alike, so no part meets in one task. Equal
vectors are folded before the search: only the ``k + 1`` smallest ids of a vector can be
among anybody's ``k`` nearest, and equal query vectors are searched once.

Vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part, nor do rows with a null id. An exactly repeated row
counts once; ids that repeat with other vectors are all candidates, except for that id's
own queries. With fewer candidates than ``k`` all are returned. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import by_batch, table
from quirefold.session import materialize

SAMPLE, GRAPH_DEGREE = 8192, 10
ROWS_PER_PART, MAX_PARTS = 1500, 128
MASS, MIN_PARTS = 0.985, 2
HIDDEN, STEPS, BATCH, RATE = 128, 1200, 512, 0.004
ROW_BLOCK, QUERY_BLOCK = 8192, 512

VALID = (
    "vec_id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and "
    "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part."""
    valid = vectors.select("vec_id", "embedding").where(F.expr(VALID))
    usual = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return valid.where(F.size("embedding") == (usual["d"] if usual else 0))


def _neighbours(x: np.ndarray, degree: int) -> np.ndarray:
    """Indexes of each row's nearest other rows, nearest first."""
    norms, out = (x * x).sum(axis=1), []
    for at in range(0, len(x), 1024):
        d = norms[at : at + 1024, None] + norms - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        out.append(np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1), axis=1))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of near-equal size with few graph edges between them.

    Starts from median splits along the widest direction, then lets each vertex move to
    the part of most of its neighbours while that part has room.
    """
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred[:2048], full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
        order, left = rows[np.argsort(centred @ axis, kind="stable")], n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    both: list[list[int]] = [list(r) for r in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].append(i)
    room = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(label, minlength=parts)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[both[i]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != label[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer; learns the share of a vector's neighbours (and itself) in each part."""

    def __init__(self, x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int) -> None:
        rng = np.random.default_rng(9)
        self.shift, self.scale = x.mean(axis=0), x.std() + 1e-12
        dim = x.shape[1]
        w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
        target[np.arange(len(x)), label] += 1
        target /= target.sum(axis=1, keepdims=True)
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        z = (x - self.shift) / self.scale
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), BATCH)
            hidden = np.maximum(z[pick] @ w[0] + w[1], 0)
            p = self._softmax(hidden @ w[2] + w[3])
            e = (p - target[pick]) / BATCH
            back = (e @ w[2].T) * (hidden > 0)
            rate = RATE * (1 - step / (STEPS + 1))
            for i, g in enumerate((z[pick].T @ back, back.sum(axis=0), hidden.T @ e, e.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        self.w = w

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.shift) / self.scale @ self.w[0] + self.w[1], 0)
        return self._softmax(hidden @ self.w[2] + self.w[3])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def train(rows: DataFrame, count: int) -> Router | None:
    """The router over the distinct vectors of ``rows``; None when one part holds them all."""
    parts = min(MAX_PARTS, -(-count // ROWS_PER_PART))
    if parts < 2:
        return None
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    x = np.unique(_matrix(picked.column("embedding").combine_chunks()), axis=0)
    degree = min(GRAPH_DEGREE, len(x) - 1)
    if degree < 1 or len(x) < 4 * parts:
        return None
    graph = _neighbours(x, degree)
    return Router(x, balanced_parts(x, graph, parts), graph, parts)


def _placed(rows: DataFrame, router: Router | None) -> DataFrame:
    """``rows`` plus ``part``."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = np.zeros(batch.num_rows, np.int32) if router is None else router(_matrix(batch.column("embedding"))).argmax(axis=1).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return by_batch(rows, place, f"{fields}, part int")


def _routed(queries: DataFrame, router: Router | None, sizes: dict[int, int], k: int, mass: float) -> DataFrame:
    """``queries`` once per part they visit."""
    order = np.array([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)] if router is None else [sizes.get(p, 0) for p in range(len(router.w[3]))])

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.ones((batch.num_rows, 1)) if router is None else router(_matrix(batch.column("embedding")))
        ranked = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, ranked, axis=1), axis=1) - np.take_along_axis(p, ranked, axis=1)
        rows_before = np.cumsum(order[ranked], axis=1) - order[ranked]
        visit = (before < mass) | (np.arange(p.shape[1]) < MIN_PARTS) | (rows_before < 4 * (k + 1))
        row, col = np.nonzero(visit)
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([*(c.take(pick) for c in batch.columns), pa.array(ranked[row, col].astype(np.int32))], [*batch.schema.names, "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return by_batch(queries, route, f"{fields}, part int")


def _blocked(rows: DataFrame, key: str, own: str, own_sizes: dict[int, int], block: int, other: str, other_sizes: dict[int, int], other_block: int) -> DataFrame:
    """Deal rows of a part into its own blocks, once for every block of the other side."""

    def blocks(sizes: dict[int, int], n: int):
        arms = [F.lit(v) for p, s in sorted(sizes.items()) for v in (p, max(1, -(-s // n)))]
        return F.coalesce(F.element_at(F.create_map(*arms), F.col("part")), F.lit(1)) if arms else F.lit(1)

    return rows.withColumn(own, F.pmod(F.xxhash64(key), blocks(own_sizes, block)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), blocks(other_sizes, other_block) - 1))
    )


def _part_sizes(rows: DataFrame) -> dict[int, int]:
    return {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}


def nearest(vectors: DataFrame, is_query, k: int = 10, mass: float = MASS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every query, its own id left out."""
    valid = usable(vectors)
    smallest = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = materialize(valid.withColumn("_rank", smallest).where(F.col("_rank") <= k + 1).select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"]))
    count = rows.count()
    router = train(rows, count)
    placed = materialize(_placed(rows, router))

    asked = valid.where(is_query)
    searched = asked.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    row_sizes = _part_sizes(placed)
    routed = materialize(_routed(searched, router, row_sizes, k, mass))
    query_sizes = _part_sizes(routed)
    left = _blocked(placed, "vec_id", "rb", row_sizes, ROW_BLOCK, "qb", query_sizes, QUERY_BLOCK)
    right = _blocked(routed, "query", "qb", query_sizes, QUERY_BLOCK, "rb", row_sizes, ROW_BLOCK)
    keys = ["part", "rb", "qb"]

    def rerank(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(queries):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x = np.stack(found["embedding"].to_numpy()).astype(np.float64)
        q = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        ids = found["vec_id"].to_numpy()
        norms, out = (x * x).sum(axis=1), []
        keep = min(k + 1, len(x))
        for query, vector in zip(queries["query"].to_numpy(), q):
            # a quick distance picks candidates with a margin for its rounding, the exact one ranks them
            own = vector @ vector
            quick = norms - 2 * (x @ vector) + own
            bound = np.partition(quick, keep - 1)[keep - 1] + 1e-9 * (own + norms.max())
            near = np.flatnonzero(quick <= bound)
            exact = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[: k + 1]
            out.append(pd.DataFrame({"query": query, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "query bigint, vec_id bigint, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    # equal query vectors share one search, under the smallest of their ids
    groups = asked.select("vec_id", "embedding").distinct().join(searched, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    mine = Window.partitionBy("query_id").orderBy("score", "vec_id")
    per_query = groups.join(top, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return per_query.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
