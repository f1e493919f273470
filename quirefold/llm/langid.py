"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a word's bytes (ASCII lowered) from both ends, with a blank before and
after, and gives every byte position a distribution over the languages learned; a document's probabilities are the mean over all its positions.
It is written and trained in numpy, by backpropagation through time with Adam.

The recurrence starts anew at white space. Positions of equal words are therefore equal,
and a worker labels a word once however often it occurs; every position of the whole text
counts in the mean. A run of more than ``SPAN`` bytes without white space is cut at character
borders; each piece is read with up to ``AROUND`` bytes of its neighbours on either side, whose
positions count in their own piece only.

Every language of the table is learned. The fit reads at most ``PER_LANGUAGE`` documents of
each, those with the smallest id hash, and at most ``WORDS_OF`` words of each; with more than
``LANGUAGES`` languages fewer documents of each, ``LEAST`` at least. Scoring is one stage without a shuffle.

Null texts and texts without a letter are ``und`` with score 0. Without documents to learn
from everything is ``und``. A row with a null id is predicted, counts as not held out and
is not learned from; ids that repeat are predicted row by row. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import by_batch, hold, id_crc, offsets, run_sums, table

SPAN, AROUND, HIDDEN = 24, 12, 16
PER_LANGUAGE, WORDS_OF, LANGUAGES, LEAST = 250, 80, 64, 20
STEPS, BATCH, RATE = 1500, 256, 0.01
UNKNOWN = "und"
#: Words a worker remembers, and bytes of text worked on at a time.
REMEMBERED, TOGETHER = 300_000, 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _border(word: bytes, at: int, step: int) -> int:
    """The nearest character border from ``at`` on in direction ``step``; bytes that are no UTF-8 have one everywhere."""
    for k in range(4):
        i = at + step * k
        if not 0 < i < len(word) or word[i] & 0xC0 != 0x80:
            return min(max(i, 0), len(word))
    return at


def spans(word: bytes) -> list[tuple[bytes, int, int]]:
    """Pieces of a word as ``bytes, from, to``: what is read, and which part of it counts."""
    if len(word) <= SPAN:
        return [(word, 0, len(word))]
    out, at = [], 0
    while at < len(word):
        end = _border(word, at + SPAN, -1) if at + SPAN < len(word) else len(word)
        low, high = _border(word, max(0, at - AROUND), 1), _border(word, min(len(word), end + AROUND), -1)
        out.append((word[low:high], at - low, end - low))
        at = end
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights ``in_d, rec_d, bias_d`` for each direction d, and ``out, out_bias``; gates in the order update, reset, candidate."""

    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.name, h = languages, uuid.uuid4().hex, HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"in_{d}"] = rng.normal(0, 0.2, (257, 3 * h)).astype(np.float32)
            self.w[f"rec_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.w[f"bias_{d}"] = np.zeros(3 * h, np.float32)
        self.w["out"] = rng.normal(0, 0.2, (2 * h, len(languages))).astype(np.float32)
        self.w["out_bias"] = np.zeros(len(languages), np.float32)

    @staticmethod
    def batch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte codes, blank (256) before, after and as padding; and which positions hold a byte."""
        width = max(map(len, words)) + 2
        codes = np.full((width, len(words)), 256, np.int64)
        for i, word in enumerate(words):
            codes[1 : len(word) + 1, i] = np.frombuffer(word, np.uint8)
        return codes, codes < 256

    @staticmethod
    def _inside(codes: np.ndarray) -> np.ndarray:
        """1 on a word's bytes and the blanks beside them; padding leaves no trace, whatever the batch."""
        real = codes < 256
        near = real.copy()
        near[1:] |= real[:-1]
        near[:-1] |= real[1:]
        return near.astype(np.float32)[:, :, None]

    def _direction(self, d: str, codes: np.ndarray, keep: list | None) -> np.ndarray:
        h, u = HIDDEN, self.w[f"rec_{d}"]
        x = self.w[f"in_{d}"][codes] + self.w[f"bias_{d}"]
        state, inside = np.zeros((codes.shape[1], h), np.float32), self._inside(codes)
        out = np.empty((*codes.shape, h), np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = (z * state + (1 - z) * c) * inside[t]
            out[t] = state
        return out

    def probabilities(self, codes: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """positions x words x languages."""
        both = np.concatenate([self._direction(d, codes, None if kept is None else kept.setdefault(d, [])) for d in "fb"], axis=2)
        logits = both @ self.w["out"] + self.w["out_bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        if kept is not None:
            kept["both"] = both
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, words: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all byte positions, by backpropagation through time."""
        h, kept = HIDDEN, {}
        codes, real = self.batch(words)
        p = self.probabilities(codes, kept)
        error = p.copy()
        error[:, np.arange(len(words)), labels] -= 1
        error *= (real / real.sum())[:, :, None]
        g = {"out": np.tensordot(kept["both"], error, ((0, 1), (0, 1))), "out_bias": error.sum((0, 1))}
        above, inside = error @ self.w["out"].T, self._inside(codes)
        for k, d in enumerate("fb"):
            u = self.w[f"rec_{d}"]
            gx, gu = np.zeros((*codes.shape, 3 * h), np.float32), np.zeros_like(u)
            flow = np.zeros((len(words), h), np.float32)
            for t, state, z, r, c in reversed(kept[d]):
                flow = (flow + above[t, :, k * h : (k + 1) * h]) * inside[t]
                gc = flow * (1 - z) * (1 - c * c)
                through = gc @ u[:, 2 * h :].T
                gates = np.concatenate([flow * (state - c) * z * (1 - z), through * state * r * (1 - r)], axis=1)
                gu[:, : 2 * h] += state.T @ gates
                gu[:, 2 * h :] += (r * state).T @ gc
                gx[t] = np.concatenate([gates, gc], axis=1)
                flow = flow * z + through * r + gates @ u[:, : 2 * h].T
            g[f"rec_{d}"], g[f"bias_{d}"] = gu, gx.sum((0, 1))
            g[f"in_{d}"] = np.zeros_like(self.w[f"in_{d}"])
            np.add.at(g[f"in_{d}"], codes.ravel(), gx.reshape(-1, 3 * h))
        return g

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        by_language = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        for step in range(1, steps + 1):
            # each language equally often, words of like length together
            picks = np.concatenate([rng.choice(own, BATCH // len(by_language) + 1) for own in by_language if len(own)])
            g = self.gradients([words[i] for i in picks], labels[picks])
            rate = RATE * (1 - step / (steps + 1))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def share(self, entries: int, least: int = 1) -> int:
        """As many entries of a row of probabilities each as take the memory of ``entries`` with ``LANGUAGES`` languages."""
        return min(entries, max(least, entries * LANGUAGES // max(1, len(self.languages))))

    def word_sums(self, pieces: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Per piece the probabilities summed over the positions that count."""
        out = np.empty((len(pieces), len(self.languages)), np.float32)
        order, many = sorted(range(len(pieces)), key=lambda i: len(pieces[i][0])), self.share(4096)
        for at in range(0, len(order), many):
            part = order[at : at + many]
            codes, _ = self.batch([pieces[i][0] for i in part])
            low, high = (np.array([pieces[i][k] for i in part]) for k in (1, 2))
            place = np.arange(len(codes))[:, None] - 1
            out[part] = (self.probabilities(codes) * ((place >= low) & (place < high))[:, :, None]).sum(axis=0)
        return out


class Reader:
    """Document probabilities from a network, with the sums of words seen kept in one table."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(network.languages)), np.float32)

    def _learn(self, split: list[list[bytes]]) -> None:
        fresh = list(set().union(*split).difference(self.row))
        if len(self.row) + len(fresh) > self.network.share(REMEMBERED):
            self.row, self.sums = {}, self.sums[:0]
            fresh = list(set().union(*split))
        parts = [spans(w) for w in fresh]
        starts = offsets(np.array([len(p) for p in parts], np.int64))
        flat = self.network.word_sums(list(chain.from_iterable(parts))) if fresh else self.sums[:0]
        self.row.update(zip(fresh, range(len(self.sums), len(self.sums) + len(fresh))))
        self.sums = np.concatenate([self.sums, run_sums(flat, starts).astype(np.float32)])

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities; zero rows for texts without a byte to label."""
        split = [t.lower().split() for t in texts]
        self._learn(split)
        starts = offsets(np.array([len(w) for w in split], np.int64))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64, int(starts[-1]))
        sums = run_sums(self.sums[rows], starts)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


#: The reader of the network a worker saw last; later tasks of the same job go on with it.
_LAST: dict[str, Reader] = {}


def reader_of(network: Network) -> Reader:
    hold("languages", _LAST.clear)
    if network.name not in _LAST:
        _LAST.clear()
        _LAST[network.name] = Reader(network)
    return _LAST[network.name]


def may_learn(doc_id: Column) -> Column:
    """crc32 of the id modulo 4 is not 2; NULL for a NULL id."""
    return id_crc(doc_id) % 4 != 2


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Network:
    marked = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    ids = marked.select("lang", "doc_id").distinct()
    n_languages = marked.select("lang").distinct().count()
    if n_languages > LANGUAGES:
        per_language = max(min(LEAST, per_language), per_language * LANGUAGES // n_languages)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # the documents of LANGUAGES languages, or LEAST of each, are broadcast
    chosen = ids.select("lang", "doc_id", rank.alias("_rank")).where(F.col("_rank") <= per_language).select("lang", "doc_id")

    def picked(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = {part for word in text.lower().split() for part, _, _ in spans(word)}
            out.append(sorted(words, key=lambda w: (zlib.crc32(w), w))[:WORDS_OF])
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["lang", "words"])

    sample = docs.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).where(F.col("text").isNotNull())
    sample = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    pairs = sorted((r["lang"], bytes(w)) for r in by_batch(sample, picked, "lang string, words array<binary>").collect() for w in r["words"])
    languages = sorted({lang for lang, _ in pairs})
    network = Network(languages)
    if pairs:
        index = {lang: i for i, lang in enumerate(languages)}
        network.fit([w for _, w in pairs], np.array([index[lang] for lang, _ in pairs]), steps)
    return network


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = reader_of(network)
        texts = batch.column(1).to_pylist()
        langs, scores, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < TOGETHER or end == at):
                size += len(texts[end] or "")
                end += 1
            part = texts[at:end]
            p = reader.documents([(t or "").encode("utf-8", "replace") for t in part]) if network.languages else np.zeros((len(part), 1))
            for text, row in zip(part, p):
                known = bool(network.languages) and text is not None and _LETTER.search(text) is not None
                best = int(row.argmax())
                langs.append(network.languages[best] if known else UNKNOWN)
                scores.append(float(min(1.0, row[best])) if known else 0.0)
            at = end
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), predicted, f"doc_id {kind}, lang_pred string, score double")


def op6_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs, may_learn(F.col("doc_id"))))
    return found.select("doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
