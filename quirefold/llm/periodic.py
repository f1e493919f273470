"""Periodic runs: stretches of a text that repeat themselves, word by word.

A run is a stretch with a smallest period ``q`` that holds at least ``copies`` of it and
that no neighbouring word extends. Runs are found through a dictionary of basic factors:
for each power of two ``L`` every stretch of ``L`` words gets a number, equal stretches the
same one, made from the numbers of its two halves. Where the next stretch of the same
number lies ``q`` words on, the words up to there repeat with period ``q``; starts that
follow each other with the same step are one progression. Steps up to ``2 L`` are looked
at: those above ``L`` are met again, and in full, at the next length, those up to ``L / 2``
have been met before. A progression with a step in between is a whole run: a stretch of
``L >= q`` words cannot recur sooner inside it, so the progression ends where the run does
and proposes ``(start, length, period)`` once.

Stretches that occur once in their document lead nowhere at any greater length and are left
out, so the work is the words plus, per length, the stretches that still recur.

Texts are worked on whole, many at a time or a long one alone; nothing is shuffled. A task
holds ``CHUNK`` bytes of text, or one text, and about 100 bytes for each of its words. A
null, empty or blank text has no words, no runs and an empty collapsed text. Repeated rows
are handled row by row; an empty table gives no rows. Columns that are not kept are
ignored, kept ones travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WORD, by_batch, id_crc, offsets, small_batches, table
from quirefold.session import materialize

#: Least words of a run, and least number of periods in it.
LEAST, COPIES = 24, 3
#: Bytes of text worked on at a time.
CHUNK = 4 << 20


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys get equal numbers, and how often each number occurs."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return which, counts


def _progressions(at: np.ndarray, names: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First start, last start and step of each progression whose step is in ``size / 2 .. size``."""
    order = np.lexsort((at, names))
    where, name = at[order], names[order]
    step = np.zeros(len(at), np.int64)
    step[order[:-1]] = np.where(name[1:] == name[:-1], where[1:] - where[:-1], 0)
    near = (step <= size) & (2 * step > size)
    start, step = at[near], step[near]
    if len(start):
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1] + 1) | (step[1:] != step[:-1])
        begins = np.flatnonzero(first)
        yield start[begins], start[np.append(begins[1:], len(start)) - 1], step[begins]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """Rows ``(start, length, period)`` by start and period, of many documents at once.

    ``words`` holds a number for each word of all documents, ``bounds`` where each document
    starts and the last one ends. ``copies`` must be three or more.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    # a document may hold no run longer than itself, so periods end at a third of the longest
    longest = int(np.diff(bounds).max(initial=0)) // copies
    names, counts = _numbers(doc * (int(words.max(initial=0)) + 1) + words)
    found, size = [], 1
    while len(at) and size < 2 * longest:
        recurs = counts[names] > 1
        at, names = at[recurs], names[recurs]
        for first, last, period in _progressions(at, names, size):
            length = last - first + size + period
            keep = length >= np.maximum(least, copies * period)
            found.append(np.stack([first[keep], length[keep], period[keep]], 1))
        # a stretch of twice the length is a recurring one followed by a recurring one of its document
        place = np.searchsorted(at, at + size)
        place[place == len(at)] = 0
        pair = (at[place] == at + size) & (doc[at[place]] == doc[at]) if len(at) else np.zeros(0, bool)
        top = int(names.max(initial=0)) + 1
        at, (names, counts) = at[pair], _numbers(names[pair] * top + names[place[pair]])
        size *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, between ASCII white space, and where each text starts among them."""
    lists = pc.ascii_split_whitespace(texts)
    words, per_text = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    kept = offsets(real)[offsets(per_text)]
    return words.filter(pa.array(real)), kept


def _joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The words of each text with single spaces between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    sizes, at = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held < CHUNK or end == at):
            held += int(sizes[end])
            end += 1
        yield texts.slice(at, end - at)
        at = end


def _worked(texts: pa.Array, least: int, copies: int) -> pa.RecordBatch:
    words, bounds = words_of(texts)
    coded = words.dictionary_encode()
    runs = find_runs(coded.indices.to_numpy().astype(np.int64), bounds, least, copies)
    of = np.searchsorted(bounds, runs[:, 0], "right") - 1
    # words behind the first period of a run are dropped: mark where such stretches begin and end
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edge[:-1]) == 0
    fields = [runs[:, 0] - bounds[of], runs[:, 1], runs[:, 2]]
    spans = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"])
    per_text = offsets(np.bincount(of, minlength=len(texts)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), spans),
            _joined(words.filter(pa.array(stay)), offsets(stay)[bounds]),
        ],
        ["n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of ``keep``), ``n_words``, ``runs``, ``collapsed``.

    ``runs`` is an array of ``start, length, period`` by start and period; ``collapsed`` is
    the text without the words behind each run's first period, joined by single spaces.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = pa.Table.from_batches([_worked(t, least, copies) for t in _chunks(batch.column(1))]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([batch.column(0), *parts.columns], ["row", *parts.schema.names])

    return by_batch(rows, found, f"row {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document by its id hash repeats a piece of itself from some word on."""
    h = id_crc(F.col("doc_id"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    some = some.withColumn("_n", F.size("_words")).withColumn("_g", F.floor(F.col("_h") / 10))
    some = some.withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    some = some.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    whole = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[int(_a + (i - _a) % _p)])), ' ')")
    return some.select("doc_id", F.when(F.col("_n") > 0, whole).otherwise(F.col("text")).alias("text"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first, then the shortest period."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.element_at(runs, 1), lambda best, r: F.when(better(r, best), r).otherwise(best))


def op12_periodic(spark, sf_dir) -> DataFrame:
    with small_batches(spark):
        found = materialize(periodic_runs(planted(table(spark, sf_dir, "documents"))).select(
            "row.doc_id", "runs", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
        ))
    best = F.when(F.size("runs") > 0, most_repeated(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
