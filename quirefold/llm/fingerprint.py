"""Document fingerprints by randomised edit embedding, and the near copies they find.

A walk over the characters of a text stands on one character at a time; at step j a
random table, shared by all texts, decides from the character whether to move on. The
characters seen form a long string in which few edits of the text change few places.
Each place casts a random vote (a table of step and character) on one of ``BITS`` sums;
the signs of the sums are the fingerprint, so the share of equal bits of two prints
estimates the share of equal places: likeness = cos(pi * (1 - equal share)), 0 at least.

Walks of all texts of a batch advance together in numpy. A text is walked in stretches of
``STRETCH`` characters, each from its own start; after an edit the walks meet again within
few steps, so a stretch that begins a few characters off costs little. A text of fewer than
``SHORT`` characters is walked in several rounds, each with the characters' roles dealt
anew, until it has cast as many votes as a text of that length: bits without votes would
make all short texts alike, and one walk alone says little about a few edits.

An edited text needs the next document by id: documents are range-partitioned by id, each
task pairs neighbours as it streams, and only the first and last document of each
partition meet in a second, small step. Null text counts as empty; the fingerprint of an
empty text is all zeros. Null ids come first, rows that repeat an id are ordered by text.
A single document is its own next. An empty table gives no rows. A very long text is held,
with its edited form, by the task that walks it. Other columns are ignored.

Near copies are prints of at least ``SIMILAR`` likeness; equal prints are one class, held by
its smallest id. Bands of sampled bits find candidates in two steps, the likeness verifies
them. Coarse bands deal prints, 32 bytes each, into cells that a task holds at once. In a
cell, fine bands sort them into buckets, and what meets in a bucket is verified. More
prints take more bits, so that buckets do not grow with the table, and more bits take more
bands, so that a pair just at the threshold meets with a chance of ``FOUND`` in each step.
Prints that are joined already are not held against each other: a bucket full of copies of
one text costs little more than its size. A task hands on what its links connect, not the links.
Cells of more than ``BLOCK`` prints are dealt into blocks; blocks of different components
then meet each other. ``component_id`` is the smallest id that links reach; rows that repeat
an id are one vertex, rows without id have none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import by_batch, table
from quirefold.llm.components import components
from quirefold.session import materialize

BITS, PERIOD, STRETCH = 256, 4096, 8192
SHORT = 4096
#: Near copies: least likeness, and the least chance for a pair at that likeness to share a band.
SIMILAR, FOUND = 0.8, 0.97
#: Prints that a cell and a bucket should hold, fewest bits of a coarse band, most prints in a block.
CELL, CROWD, COARSE, BLOCK = 1 << 19, 1024, 4, 1 << 20
#: Pairs of prints that are compared at once, prints of a bucket that all others meet first.
PAIRS, CENTRES = 1 << 18, 16
#: Share of equal bits of unrelated texts of one language, measured: letters are not even.
UNRELATED = 0.57
#: Characters whose walks advance together.
TOGETHER = 4 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For step and character class: whether to move on, and the vote; class 0 is the end of a stretch."""
    rng = np.random.default_rng(20240607)
    move = rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
    vote = (rng.integers(0, 2, (PERIOD, 256)) * 2 - 1).astype(np.int16)
    move[:, 0] = vote[:, 0] = 0
    return move, vote


def band_plan(prints: int, held: int, similar: float = SIMILAR, fewest: int = 1) -> tuple[int, int]:
    """Number of bands and of bits in a band for so many distinct prints and so many in a bucket."""
    alike = 1 - math.acos(similar) / math.pi
    bits = min(40, max(fewest, round(math.log(max(1.0, prints / held)) / -math.log(UNRELATED))))
    return math.ceil(math.log(1 - FOUND) / math.log(1 - alike**bits)), bits


def band_keys(words: np.ndarray, bands: int, bits: int, step: int) -> Iterator[np.ndarray]:
    """Per band the sampled bits of each print, a row of 64-bit words; ``step`` tells coarse from fine bands."""
    for band in range(bands):
        key = np.zeros(len(words), np.int64)
        for place in np.random.default_rng([step, band]).choice(BITS, bits, replace=False):
            key = (key << 1) | ((words[:, place // 64] >> np.uint64(place % 64)) & np.uint64(1)).astype(np.int64)
        yield key


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points + (points >> 8) * 37) % 255 + 1).astype(np.uint8)


@lru_cache(maxsize=1)
def _turns() -> np.ndarray:
    """Another order of the classes for each round over a short text; the first round keeps them."""
    turns = np.zeros((SHORT, 256), np.uint8)
    rng = np.random.default_rng(11)
    turns[0] = np.arange(256)
    for turn in turns[1:]:
        turn[1:] = rng.permutation(255) + 1
    return turns


def _walk(texts: list[str]) -> np.ndarray:
    move, vote = _tables()
    parts, owner, salt = [], [], []
    for k, text in enumerate(texts):
        classes = _classes(text)
        rounds = -(-SHORT // len(classes)) if 0 < len(classes) < SHORT else 1
        for r in range(rounds):
            for c, at in enumerate(range(0, len(classes), STRETCH)):
                parts.append(_turns()[r][classes[at : at + STRETCH]] if r else classes[at : at + STRETCH])
                owner.append(k)
                salt.append(c + r)
    sums = np.zeros((len(texts), BITS), np.int32)
    if not parts:
        return sums
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    buffer = np.zeros(sum(map(len, parts)) + len(parts), np.uint8)
    starts = np.zeros(len(parts), np.int64)
    at = 0
    for lane, i in enumerate(order):
        buffer[at : at + len(parts[i])] = parts[i]
        starts[lane] = at
        at += len(parts[i]) + 1
    votes = np.zeros((BITS, len(parts)), np.int16)
    here, live, step = starts.copy(), len(parts), 0
    while live:
        for j in range(step, step + 32):
            seen = buffer.take(here[:live])
            votes[j % BITS, :live] += vote[j % PERIOD].take(seen)
            here[:live] += move[j % PERIOD].take(seen)
        step += 32
        alive = np.flatnonzero(buffer.take(here[:live]))
        live = int(alive[-1]) + 1 if len(alive) else 0
    # a stretch votes by its place in the text or by its round, so that equal stretches elsewhere do not add up
    for lane, i in enumerate(order):
        sums[owner[i]] += np.roll(votes[:, lane], 53 * salt[i]).astype(np.int32)
    return sums


def prints(texts: list[str]) -> np.ndarray:
    """Fingerprints as rows of packed bits."""
    out, at = np.zeros((len(texts), BITS // 8), np.uint8), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < TOGETHER or end == at):
            size += len(texts[end])
            end += 1
        out[at:end] = np.packbits(_walk(texts[at:end]) > 0, axis=1)
        at = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.unpackbits(a ^ b, axis=-1).sum(axis=-1) / BITS
    return np.maximum(0.0, np.cos(math.pi * differ))


FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], own: np.ndarray, following: list[str], nexts: np.ndarray) -> list[list]:
    """Result columns for documents whose next one is known."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    other = prints(changed)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        [r.tobytes().hex() for r in own], [r.tobytes().hex() for r in other],
        likeness(own, other).tolist(), likeness(own, nexts).tolist(),
    ]


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how near they and the next one are."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, kind = TaskContext.get().partitionId(), None, None

        def edge(side: str, doc_id, text) -> pa.RecordBatch:
            empty = [pa.array([None], t) for t in _TYPES]
            return pa.RecordBatch.from_arrays(
                [pa.array([doc_id], kind), *empty, pa.array([side]), pa.array([part], pa.int64()), pa.array([text], pa.string())],
                ["doc_id", *_NAMES, "side", "part", "text"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < TOGETHER or end == at):
                    size += len(texts[end])
                    end += 1
                own = prints(texts[at:end])
                row_ids, row_texts = ids[at:end], texts[at:end]
                if before is None:
                    yield edge("first", row_ids[0], row_texts[0])
                else:
                    row_ids, row_texts = [before[0], *row_ids], [before[1], *row_texts]
                    own = np.concatenate([before[2][None], own])
                if len(row_ids) > 1:
                    cols = _compared(row_ids[:-1], row_texts[:-1], own[:-1], row_texts[1:], own[1:])
                    n = len(row_ids) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, [kind, *_TYPES])] + [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
                        ["doc_id", *_NAMES, "side", "part", "text"],
                    )
                before = (row_ids[-1], row_texts[-1], own[-1])
                at = end
        if before is not None:
            yield edge("last", before[0], before[1])

    rows = materialize(ordered.mapInArrow(stream, f"doc_id {id_type}, {FIELDS}, side string, part bigint, text string"))

    # two documents per partition are left: the last of each, and the first of the next partition that has rows
    heads = rows.where("side = 'first'").select("part", F.col("text").alias("next_text"))
    turn = Window.orderBy("part")
    follows = heads.select(
        "part", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    pairs = (
        rows.where("side = 'last'").select("doc_id", "text", "part").join(follows, "part")
        .join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            if ids:
                cols = _compared(ids, texts, prints(texts), following, prints(following))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(0).type, *_TYPES])], ["doc_id", *_NAMES])

    inner = rows.where("side is null").select("doc_id", *_NAMES)
    return inner.unionByName(pairs.mapInArrow(meet, f"doc_id {id_type}, {FIELDS}"))


def _found(above: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Smallest member of the set of each vertex; ``above`` leads there and is shortened."""
    top = above[at]
    while (above[top] != top).any():
        top = above[top]
    above[at] = top
    return top


def _unite(above: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of ``x`` and ``y``, pair by pair, under their smallest members."""
    a, b = _found(above, x), _found(above, y)
    apart = a != b
    if not apart.any():
        return
    tops, at = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
    u, v = at.reshape(2, -1)
    low = np.arange(len(tops))
    while (low[u] != low[v]).any():
        p, q = low[u], low[v]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        low = _found(low, np.arange(len(tops)))
    above[tops] = tops[low]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Different bits of every row of ``a`` from every row of ``b``; rows of a bucket share a bit, so a byte holds them."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for word in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, word] ^ b[None, :, word])
    return out


def _verify(words: np.ndarray, bucket: np.ndarray, above: np.ndarray, most: int) -> None:
    """Unite the prints of a bucket that differ in at most ``most`` bits."""
    # large groups of near copies come together around some of their own, spread over the bucket
    if len(bucket) > 4 * CENTRES:
        centres = bucket[np.linspace(0, len(bucket) - 1, CENTRES).astype(np.int64)]
        for at in range(0, len(bucket), PAIRS // CENTRES):
            x, y = np.nonzero(_differ(words[centres], words[bucket[at : at + PAIRS // CENTRES]]) <= most)
            _unite(above, centres[x], bucket[y + at])
    sets = _found(above, bucket)
    order = np.argsort(sets, kind="stable")
    bucket, sets = bucket[order], sets[order]
    step, at = max(1, PAIRS // len(bucket)), 0
    while at < len(bucket) and sets[at] != sets[-1]:
        end = min(at + step, len(bucket))
        # rows of one set are not held against the rest of it
        ahead = int(np.searchsorted(sets, sets[at], "right")) if sets[at] == sets[end - 1] else at
        x, y = np.nonzero(_differ(words[bucket[at:end]], words[bucket[ahead:]]) <= most)
        apart = sets[x + at] != sets[y + ahead]
        if apart.any():
            _unite(above, bucket[x[apart] + at], bucket[y[apart] + ahead])
        at = end


def united(words: np.ndarray, root: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Prints of a cell, with what they are known to belong to -> pairs of prints, by index, that connect more."""
    _, first, member = np.unique(root, return_index=True, return_inverse=True)
    known = first[member]
    above = known.copy()
    most = math.floor(BITS * math.acos(similar) / math.pi)
    bands, bits = band_plan(len(words), CROWD, similar)
    for key in band_keys(words, bands, bits, 1):
        sets = _found(above, np.arange(len(words)))
        order = np.lexsort((sets, key))
        key, sets = key[order], sets[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(start[1:], len(key))
        for at in np.flatnonzero(sets[start] != sets[ends - 1]):
            _verify(words, order[start[at] : ends[at]], above, most)
    low = _found(above, np.arange(len(words)))
    more = np.flatnonzero((low != known) & (known == np.arange(len(words))))
    return more, low[more]


_WORDS = ["w0", "w1", "w2", "w3"]


def _by_cell(rows: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """Edges ``u, v`` that connect near copies of each cell; rows have ``doc, root`` and the words of the print."""
    dealt = rows.select(*keys, "doc", "root", *_WORDS).repartition(*keys).sortWithinPartitions(*keys, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def edges() -> Iterator[pa.RecordBatch]:
            cell = pa.concat_tables(held)
            if cell.num_rows > 1:
                doc = cell.column("doc").to_numpy()
                words = np.stack([cell.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
                x, y = united(words, cell.column("root").to_numpy(), similar)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y])], ["u", "v"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                key = np.stack([now.column(c).to_numpy() for c in keys], axis=1)
                ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                for a, b in zip(ends[:-1], ends[1:]):
                    if last is not None and (key[a] != last).any():
                        yield from edges()
                    held.append(now.slice(a, b - a))
                    last = key[a]
        if held:
            yield from edges()

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_copies(prints: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``fingerprint, component_id`` of every distinct print in ``doc_id, fingerprint``; ids are whole numbers."""
    classes = materialize(
        prints.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("bigint")).alias("doc")).where("doc is not null")
        .select("doc", F.unhex("fingerprint").alias("print"))
    )
    total = classes.count()
    bands, bits = band_plan(total, CELL, similar, COARSE)
    files = max(8, -(-total // 50_000))

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
        cells = np.concatenate([key + (band << 40) for band, key in enumerate(band_keys(words, bands, bits, 0))])
        doc = np.tile(batch.column(0).to_numpy(), bands)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (cells, doc, *np.tile(words.view(np.int64), (bands, 1)).T)], ["cell", "doc", *_WORDS])

    rows = by_batch(classes, dealt, "cell bigint, doc bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    crowded = materialize(rows.groupBy("cell").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK).coalesce(8))
    if crowded.isEmpty():
        return _named(classes, components(materialize(_by_cell(rows.withColumn("root", F.col("doc")), ["cell"], similar).distinct().repartition(files)), files))
    own = F.pmod(F.xxhash64("doc"), F.ceil(F.coalesce("held", F.lit(1)) / BLOCK)).cast("int")
    blocks = rows.join(crowded, "cell", "left").withColumn("block", own).withColumn("root", F.col("doc"))
    links = materialize(_by_cell(blocks, ["cell", "block"], similar).distinct().repartition(files))
    roots = components(links, files)
    more = _across(rows.join(crowded.select("cell"), "cell"), roots, similar)
    links = materialize(links.unionByName(more).distinct().repartition(files))
    return _named(classes, components(links, files))


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    return named.select(F.lower(F.hex("print")).alias("fingerprint"), F.coalesce("root", "doc").alias("component_id"))


def _across(rows: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Edges between different components of crowded cells.

    Components that fill blocks have blocks of their own, the others share blocks; blocks of
    one component do not meet.
    """
    rooted = materialize(rows.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")))
    sizes = rooted.groupBy("cell", "root").agg(F.count("*").alias("own"))
    small = F.col("own") < BLOCK
    shape = sizes.groupBy("cell").agg(F.count("*").alias("roots"), F.sum(F.when(small, F.col("own")).otherwise(0)).alias("small"))
    plan = materialize(
        sizes.join(shape.where("roots > 1"), "cell").select(
            "cell", "root", F.when(small, F.lit(None)).otherwise(F.col("root")).alias("owner"),
            F.ceil(F.when(small, F.col("small")).otherwise(F.col("own")) / BLOCK).cast("int").alias("slots"),
        )
    )
    slot = F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("doc")), F.col("slots")).cast("int")
    block = F.xxhash64("owner", "slot", F.col("owner").isNull()).alias("block")
    placed = rooted.join(plan, ["cell", "root"]).withColumn("slot", slot).select("cell", "doc", "root", *_WORDS, block)
    blocks = plan.select("cell", "owner", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).distinct().select("cell", "owner", block)
    p = blocks.withColumnsRenamed({"owner": "_p_owner", "block": "_p"})
    q = blocks.withColumnsRenamed({"owner": "_q_owner", "block": "_q"})
    apart = F.col("_p_owner").isNull() | F.col("_q_owner").isNull() | (F.col("_p_owner") != F.col("_q_owner"))
    meets = p.join(q, "cell").where((F.col("_p") <= F.col("_q")) & apart).withColumn("meeting", F.xxhash64("_p", "_q"))
    sides = meets.select("cell", "meeting", F.explode(F.array_distinct(F.array("_p", "_q"))).alias("block"))
    return _by_cell(placed.join(sides, ["cell", "block"]), ["cell", "meeting"], similar)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``fingerprint_with_next``, and the component of near copies that each document is in."""
    made = fingerprint_with_next(docs)
    found = near_copies(made.select("doc_id", "fingerprint"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return made.join(found, "fingerprint", "left").select("doc_id", *_NAMES, component)


def op10_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
