"""Quality classifier: logistic regression on hashed word n-grams, fitted with FTRL-proximal.

A document is the bag of its hashed word unigrams and bigrams, over the words themselves
and over their shapes (letter case and the signs around the letters, and whether a word
repeats the one before it). Its score is a sparse dot product with the weights, squashed.

The fit reads at most ``SAMPLE`` labelled documents, those with the smallest id hash, so
it is the same on every run; features are hashed in tasks and only index/count pairs reach
the driver, ``SAMPLE`` documents at most. Scoring reads every text whole, in one stage
without a shuffle; the weights (``2**BITS`` floats) travel with the task.

Null, empty and blank texts have no n-gram and get the score of the bias. Without labels
every score is 0.5. A row with a null id is scored, counts as not held out and is not
learned from. An id that repeats is scored row by row and learned from once, by its
smallest text; conflicting labels count as the smaller. Other columns are ignored, and
labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WordCache, by_batch, hold, id_crc, offsets, run_sums, table

BITS = 18
#: Labelled documents that a fit may read.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.0005, 0.0001
#: Bytes of text handled at a time when scoring.
CHUNK = 3 << 19


def _two_hashes(word: bytes) -> int:
    """Hash of the word above, hash of its shape below."""
    text = word.decode("utf-8", "replace")
    letters = [c for c in text if c.isalpha()]
    case = "none" if not letters else "upper" if len(letters) > 1 and all(c.isupper() for c in letters) else "title" if letters[0].isupper() else "lower"
    signs = "".join(sorted({c for c in text if not c.isalnum()}))[:8]
    shape = f"{case}|{signs}|{any(c.isdigit() for c in text)}|{min(len(text), 24) // 6}"
    return zlib.crc32(word) << 32 | zlib.crc32(shape.encode())


_SEEN = WordCache(_two_hashes, 100_000)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all documents in one array, and where each document starts.

    Per word: itself, its shape, the pair with the word before, the shape pair with it.
    """
    hold("quality", _SEEN.clear)
    split = [(t or b"").split() for t in texts]
    starts = offsets(np.array([len(w) for w in split], np.int64))
    n = int(starts[-1])
    both = np.fromiter((_SEEN[w] for words in split for w in words), np.uint64, n)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    first = np.zeros(n, bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    word_before, shape_before = np.roll(word, 1), np.roll(shape, 1)
    word_before[first] = shape_before[first] = 1
    repeat = np.where(word == word_before, np.uint64(1 << 40), np.uint64(0))
    slots = np.stack(
        [
            _slots(word, 11),
            _slots(shape, 22),
            _slots(word * np.uint64(31) + word_before, 33),
            _slots(shape * np.uint64(31) + shape_before + repeat, 44),
        ],
        axis=1,
    )
    return slots, starts


def fit(rows: list[tuple[bytes, bytes, int, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias. A row is (slots, counts, number of words, label), slots and
    counts as four-byte numbers; FTRL-proximal takes one row at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i=slice(None)):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, counts, size, label in rows:
            i = np.append(np.frombuffer(slots, "<u4"), 1 << BITS)
            values = np.append(np.frombuffer(counts, "<f4") / max(size, 1), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights().astype(np.float32)


def sample_of(docs: DataFrame, labels: DataFrame, learn: Column, size: int) -> DataFrame:
    """``_y, _text`` of at most ``size`` labelled documents, in the order of their id hash."""
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
        .where(learn)
    )
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # at most ``size`` pairs of numbers are broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> np.ndarray:
    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, starts = features(batch.column(2).cast(pa.binary()).to_pylist())
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            found, counts = np.unique(slots[a:b], return_counts=True)
            out.append((found.astype("<u4").tobytes(), counts.astype("<f4").tobytes(), int(b - a)))
        cols = [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "y", "slots", "counts", "n"])

    sample = sample_of(docs, labels, learn, size)
    rows = by_batch(sample, hashed, f"id {sample.schema['doc_id'].dataType.simpleString()}, y int, slots binary, counts binary, n bigint")
    found = sorted(rows.collect(), key=lambda r: zlib.crc32(str(r["id"]).encode()))
    return fit([(bytes(r["slots"]), bytes(r["counts"]), r["n"], r["y"]) for r in found])


def score(docs: DataFrame, weights: np.ndarray, out: str) -> DataFrame:
    """``docs`` plus ``out``, the probability of label 1."""
    names = docs.columns

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(names.index("text")).cast(pa.binary()).to_pylist()
        logits = np.full(len(texts), float(weights[-1]))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < CHUNK or end == at):
                size += len(texts[end] or b"")
                end += 1
            slots, starts = features(texts[at:end])
            sums = run_sums(weights[slots].sum(axis=1, dtype=np.float64), starts)
            logits[at:end] += sums / np.maximum(np.diff(starts), 1)
            at = end
        p = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_batch(docs, scored, f"{fields}, `{out}` double")


def may_learn(doc_id: Column) -> Column:
    """crc32 of the id modulo 3 is not 1; NULL for a NULL id."""
    return id_crc(doc_id) % 3 != 1


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"), may_learn(F.col("doc_id")))
    scored = score(docs, weights, "score")
    return scored.select(
        "doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
