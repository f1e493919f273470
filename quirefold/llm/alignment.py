"""Tokens of two vocabularies laid over each other, with corpus-wide counts of linked ids.

Each text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B), once; the ids are written. Byte offsets where tokens of both end cut the
tokens into groups; an A and a B token whose bytes overlap are a link.

The first pass lays the ids of all documents over each other and writes how often each id
pair is linked, summed per task. Distinct pairs get a minimal perfect hash, built bucket by
bucket in tasks. Every task over the written sums then fills a dense vector of counts, and
of the pairs themselves, indexed by the hash; vectors are added up as a tree, ``FAN`` at a
time, and a slot that two pairs claim is an error. The second pass lays the ids over each
other again and looks up the count of each link, comparing the pair kept in its slot.

Distinct pairs are bounded by the two vocabularies, not by the corpus. At most ``SLICE`` of
them travel to the tasks at once (about 20 bytes each); with more, the second pass goes
over the ids once per slice and adds up. The best count of each B id is a vector as long as
the vocabulary. Nothing else reaches the driver.

A task holds ``CHUNK`` bytes of text, or one text, and about a hundred bytes for each of
its tokens. Texts that are null, empty or not restored by both vocabularies have no tokens:
zeros and an empty group text. Repeated rows count again and are returned again. An empty
table gives no rows. Columns that are not kept are ignored, kept ones travel in one struct.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import by_batch, offsets, small_batches, table
from quirefold.llm.encoding import load
from quirefold.llm.perfect import BUCKET_KEYS, LIMIT, PerfectHash, bucket_of, build
from quirefold.session import materialize

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text worked on at a time; summed pairs a task holds before it writes them.
CHUNK, HELD = 4 << 20, 1 << 20
#: Pairs that travel to the tasks at once; slots of a block of a vector; vectors added up at a time.
SLICE, BLOCK, FAN = 1 << 21, 1 << 16, 16


def byte_signs() -> dict[str, int]:
    """The signs by which a byte-level vocabulary writes bytes: visible ones as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabularies:
    """Ids of texts under both vocabularies, and the bytes of every id."""

    def __init__(self, a: str, b: str) -> None:
        self.names, self.b = (a, b), load(b)
        tokenizer = load(a)
        signs, entries = byte_signs(), tokenizer.get_vocab()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = entry.encode() if entry in special else bytes(signs[c] for c in entry)
        tokenizer.encode_special_tokens = True
        self.a = tokenizer
        self.ranked = {self.bytes_a[i]: i for entry, i in entries.items() if entry not in special}
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        if len(self.bytes_a) * len(self.bytes_b) > LIMIT or max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids or pairs of these vocabularies are too large")
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.raw_a, self.raw_b = (pa.array(v, pa.binary()) for v in (self.bytes_a, self.bytes_b))
        self.in_order = self._merges_in_order()

    def _merges_in_order(self) -> bool:
        """Whether ids rise with the merges, so that ranks say all that the merges do."""
        merges = json.loads(self.a.to_str())["model"]["merges"]
        entries = self.a.get_vocab()
        ids = [entries["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        return ids == sorted(ids) and len(set(ids)) == len(ids)

    @cached_property
    def _by_rank(self):
        """The same vocabulary in the library that is several times faster; None where ranks do not say it all."""
        import public_tokenizers
        import tiktoken

        if not self.in_order:
            return None
        return tiktoken.Encoding(self.names[0], pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranked, special_tokens={})

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B adds the space in front by itself; an empty text has no ids."""
        spaced = [" " + t if t else "" for t in texts]
        if self._by_rank is not None:
            a = list(map(self._by_rank.encode_ordinary, spaced))
        else:
            a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    @cached_property
    def shown(self) -> pa.Array:
        """Ids as text with what follows them: A with a comma, A with a bar, B with a comma, a semicolon, nothing."""
        a, b = (list(map(str, range(len(v)))) for v in (self.bytes_a, self.bytes_b))
        return pa.array([*[x + "," for x in a], *[x + "|" for x in a], *[x + "," for x in b], *[x + ";" for x in b], *b], pa.string())


@lru_cache(maxsize=1)
def _words(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _restored(raw: pa.Array, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts the ids give back."""
    made = bytes(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), raw.take(pa.array(ids))), b"")[0].as_buffer())
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = offsets(_sums(pc.binary_length(raw).to_numpy(zero_copy_only=False)[ids].astype(np.int64), offsets(counts)))
    same = np.diff(ends) == sizes
    if same.all() and made == b"".join(texts):
        return same
    at = ends.tolist()
    return np.array([s and made[i:j] == t for s, i, j, t in zip(same, at, at[1:], texts)], bool)


def encoded(texts: list[str], a: str, b: str) -> tuple[list[bytes], list[bytes]]:
    """Ids of each text under both vocabularies as two-byte numbers; none where the text is not restored."""
    words = _words(a, b)
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    whole, sides = np.ones(len(texts), bool), []
    for raw, lists in zip((words.raw_a, words.raw_b), words.ids(texts)):
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
        whole &= _restored(raw, ids, counts, wanted)
        sides.append((ids.astype("<u2").tobytes(), (2 * offsets(counts)).tolist()))
    return tuple([data[i:j] if w else b"" for w, i, j in zip(whole, at, at[1:])] for data, at in sides)


@dataclass
class Laid:
    """Tokens of many documents laid over each other. Bounds say where each document starts."""

    a: np.ndarray
    b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    links: np.ndarray
    bounds: np.ndarray  # of links
    group_a: np.ndarray  # the group of each A token
    group_b: np.ndarray
    bounds_g: np.ndarray  # of groups


def _numbers_of(side: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two-byte numbers of all rows, and where each row starts."""
    starts = np.frombuffer(side.buffers()[1], np.int32)[side.offset : side.offset + len(side) + 1].astype(np.int64)
    data = side.buffers()[2]
    numbers = np.frombuffer(data, "<u2")[starts[0] // 2 : starts[-1] // 2] if data is not None and data.size else np.zeros(0, "<u2")
    return numbers.astype(np.int64), (starts - starts[0]) // 2


def lay(side_a: pa.Array, side_b: pa.Array, words: Vocabularies) -> Laid:
    """Documents one after the other: a document's end is an end of both sides."""
    (a, of_a), (b, of_b) = map(_numbers_of, (side_a, side_b))
    end_a, end_b = np.cumsum(words.size_a[a]), np.cumsum(words.size_b[b])
    size = int(end_a[-1]) if len(a) else 0
    ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    ends_a[end_a] = True
    ends_b[end_b] = True
    # every stretch between two ends lies in one token of each side
    before_a, before_b = (np.cumsum(e, dtype=np.int32) - e for e in (ends_a, ends_b))
    stretches = np.flatnonzero(ends_a | ends_b)
    links = a[before_a[stretches]] * len(words.bytes_b) + b[before_b[stretches]]
    both = ends_a & ends_b
    before_g = np.cumsum(both, dtype=np.int32) - both
    text_ends = offsets(_sums(words.size_a[a], of_a))[1:]
    n_links, n_groups = (np.searchsorted(ends, text_ends, "right") for ends in (stretches, np.flatnonzero(both)))
    start = np.zeros(1, np.int64)
    return Laid(
        a, b, of_a, of_b, links, np.concatenate([start, n_links]), before_g[end_a], before_g[end_b], np.concatenate([start, n_groups]),
    )


def group_texts(laid: Laid, words: Vocabularies) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    n_a, n_b, groups = len(words.bytes_a), len(words.bytes_b), int(laid.bounds_g[-1])
    if not groups:
        return pa.array([""] * (len(laid.bounds) - 1), pa.string())
    ends_a, ends_b = (np.searchsorted(g, np.arange(groups), "right") for g in (laid.group_a, laid.group_b))
    last_a, last_b = np.zeros(len(laid.a), bool), np.zeros(len(laid.b), bool)
    last_a[ends_a - 1] = True
    last_b[ends_b - 1] = True
    closing = np.zeros(len(laid.b), bool)
    closing[laid.bounds_b[1:][np.diff(laid.bounds_b) > 0] - 1] = True
    shown = np.empty(len(laid.a) + len(laid.b), np.int64)
    # A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens of their own
    starts_b = np.append(0, ends_b[:-1])
    shown[np.arange(len(laid.a)) + starts_b[laid.group_a]] = laid.a + n_a * last_a
    shown[np.arange(len(laid.b)) + ends_a[laid.group_b]] = 2 * n_a + laid.b + n_b * (last_b.astype(np.int64) + closing)
    lists = pa.ListArray.from_arrays(pa.array(laid.bounds_a + laid.bounds_b, pa.int32()), words.shown.take(pa.array(shown)))
    return pc.binary_join(lists, "")


def _chunks(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    sizes, at = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), 0
    while at < batch.num_rows:
        end, held = at, 0
        while end < batch.num_rows and (held < most or end == at):
            held += int(sizes[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def token_ids(docs: DataFrame, keep: Sequence[str], a: str, b: str) -> DataFrame:
    """``row, a, b``: the ids of every document."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = ([], [])
        for part in _chunks(batch, "text", CHUNK):
            for side, made in zip(sides, encoded(part.column("text").fill_null("").to_pylist(), a, b)):
                side.extend(made)
        return pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(s, pa.binary()) for s in sides]], ["row", "a", "b"])

    return by_batch(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, a binary, b binary")


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, np.concatenate(counts))
    return distinct, total


def pair_sums(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """First pass: ``key, n`` - how often each id pair is linked, summed within bounds per task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for part in _chunks(batch, "a", CHUNK):
                key, n = np.unique(lay(part.column(0), part.column(1), _words(a, b)).links, return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > HELD:
                    key, n = _totals(keys, counts)
                    keys, counts = [key], [n]
                    if len(key) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                        keys, counts = [key[:0]], [n[:0]]
        key, n = _totals(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return tokens.select("a", "b").mapInArrow(summed, "key bigint, n bigint")


def hashed(pairs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, sizes, bits`` of the minimal perfect hash over the distinct keys."""

    def built(group: pa.Table) -> pa.Table:
        sizes, bits = build(np.sort(group.column("key").to_numpy()))
        return pa.table({"bucket": group.column("bucket")[:1], "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits], pa.binary())})

    keys = pairs.select("key").distinct().withColumn("bucket", bucket_of(F.col("key"), buckets))
    return keys.groupBy("bucket").applyInArrow(built, "bucket bigint, sizes array<int>, bits binary")


def _added(group: pa.Table) -> pa.Table:
    """Vectors of one block and branch, added up; an empty slot's key is -1."""
    size = len(group.column("keys")[0].as_buffer()) // 8
    counts, keys = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    for n, k in zip(group.column("counts"), group.column("keys")):
        key = np.frombuffer(k.as_buffer(), np.int64)
        if ((key >= 0) & (keys >= 0) & (key != keys)).any():
            raise ValueError("two pairs share a slot")
        counts += np.frombuffer(n.as_buffer(), np.int64)
        keys = np.maximum(keys, key)
    return pa.table(
        {"block": group.column("block")[:1], "branch": group.column("branch")[:1], "counts": pa.array([counts.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())}
    )


VECTOR = "block bigint, branch bigint, counts binary, keys binary"


def count_vectors(pairs: DataFrame, perfect) -> DataFrame:
    """``block, counts, keys``: the dense vectors of all tasks, added up as a tree."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = perfect.value
        blocks = -(-len(hash_) // BLOCK)
        counts, keys = np.zeros(blocks * BLOCK, np.int64), np.full(blocks * BLOCK, -1, np.int64)
        for batch in batches:
            key = batch.column(0).to_numpy()
            slot = hash_.slots(key)
            np.add.at(counts, slot, batch.column(1).to_numpy())
            keys[slot] = key
        branch = TaskContext.get().partitionId()
        for block in range(blocks):
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            if counts[part].any():
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "branch": branch, "counts": counts[part].tobytes(), "keys": keys[part].tobytes()}],
                    pa.schema([("block", pa.int64()), ("branch", pa.int64()), ("counts", pa.binary()), ("keys", pa.binary())]),
                )

    vectors = materialize(pairs.select("key", "n").mapInArrow(filled, VECTOR))
    branches = (vectors.agg(F.max("branch")).first()[0] or 0) + 1
    while True:
        branches = -(-branches // FAN)
        vectors = materialize(vectors.withColumn("branch", F.floor(F.col("branch") / FAN)).groupBy("block", "branch").applyInArrow(_added, VECTOR))
        if branches == 1:
            return vectors.drop("branch")


def best_counts(vectors: DataFrame, n_b: int) -> DataFrame:
    """``b, best``: the highest count of each B id over the given vectors."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n_b, np.int64)
        for batch in batches:
            for n, k in zip(batch.column(0), batch.column(1)):
                key = np.frombuffer(k.as_buffer(), np.int64)
                np.maximum.at(best, key[key >= 0] % n_b, np.frombuffer(n.as_buffer(), np.int64)[key >= 0])
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], ["b", "best"])

    return vectors.select("counts", "keys").mapInArrow(highest, "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best"))


@dataclass
class Lookup:
    """Counts of one slice of the pairs, and the best count of each B id."""

    perfect: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def found(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each link, 0 where it belongs to another slice; and whether it is its B id's best."""
        slot = self.perfect.slots(links)
        mine = slot >= 0
        mine[mine] = self.keys[slot[mine]] == links[mine]
        count = np.where(mine, self.counts[np.where(mine, slot, 0)] if len(self.counts) else 0, 0)
        return count, mine & (count == self.best[links % len(self.best)])


def _second_pass(rows: DataFrame, lookup, a: str, b: str, last: bool) -> DataFrame:
    """Adds what one slice of the pairs has for each document; the last one also tells tokens and groups."""
    kind = rows.schema["row"].dataType.simpleString()
    rest = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string" if last else "a binary, b binary"

    def looked_up(part: pa.RecordBatch) -> pa.RecordBatch:
        words = _words(a, b)
        laid = lay(part.column("a"), part.column("b"), words)
        count, best = lookup.value.found(laid.links)
        columns = {
            "row": part.column("row"),
            "n_best": pa.array(part.column("n_best").to_numpy() + _sums(best, laid.bounds)),
            "count_sum": pa.array(part.column("count_sum").to_numpy() + _sums(count, laid.bounds)),
        }
        if last:
            bounds = (laid.bounds_a, laid.bounds_b, laid.bounds_g, laid.bounds)
            columns |= {n: pa.array(np.diff(x)) for n, x in zip(("n_a", "n_b", "n_groups", "n_links"), bounds)}
            columns["groups"] = group_texts(laid, words)
        else:
            columns |= {"a": part.column("a"), "b": part.column("b")}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(looked_up, _chunks(batch, "a", CHUNK))

    return rows.mapInArrow(run, f"row {kind}, n_best bigint, count_sum bigint, {rest}")


def align(docs: DataFrame, keep: Sequence[str] = ("doc_id",), a: str = A, b: str = B, slice_pairs: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of ``keep``), n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group, A before B. ``n_best`` counts
    links whose count is the highest of their B id, ``count_sum`` adds up the counts of links.
    """
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    with small_batches(spark):
        tokens = materialize(token_ids(docs, keep, a, b), compression="zstd")
        pairs = materialize(pair_sums(tokens, a, b))
        distinct = pairs.select("key").distinct().count()
        buckets, slices = max(1, -(-distinct // BUCKET_KEYS)), max(1, -(-distinct // slice_pairs))
        of_slice: Callable = lambda bucket: F.floor(bucket * slices / buckets)
        fields = materialize(hashed(pairs, buckets))
        made = []
        for k in range(slices):
            hash_ = PerfectHash([tuple(r) for r in fields.where(of_slice(F.col("bucket")) == k).collect()], buckets)
            made.append((hash_, count_vectors(pairs.where(of_slice(bucket_of(F.col("key"), buckets)) == k), context.broadcast(hash_))))
        n_b = load(b).get_piece_size()
        best = np.zeros(n_b, np.int64)
        for _, vectors in made:
            for r in best_counts(vectors, n_b).collect():
                best[r.b] = max(best[r.b], r.best)
        zero = F.lit(0).cast("bigint")
        rows = tokens.select("*", zero.alias("n_best"), zero.alias("count_sum"))
        for k, (hash_, vectors) in enumerate(made):
            parts = [np.zeros((2, 0), np.int64)]
            for r in vectors.orderBy("block").collect():  # every block below the last slot holds some count
                parts.append(np.stack([np.frombuffer(bytes(x), np.int64) for x in (r.keys, r.counts)]))
            keys, counts = np.concatenate(parts, 1)
            lookup = context.broadcast(Lookup(hash_, keys, counts, best))
            rows = materialize(_second_pass(rows, lookup, a, b, k == slices - 1))
    return rows.select("row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op11_alignment(spark, sf_dir) -> DataFrame:
    sha = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return align(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256")
    )
