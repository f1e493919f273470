"""Quality, language and nearest neighbours: learned parts against held-out truth or brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import ann, langid, quality
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    held = [(got[i].score, y, got[i].predicted) for i, y in labels.items() if i in got and got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([p == y for _, y, p in held]) > 0.97
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_quality_of_odd_rows(spark):
    docs = cases.documents(spark)
    weights = quality.train(docs, cases.labels(spark), quality.may_learn(F.col("doc_id")))
    rows = quality.score(docs.select("doc_id", "text", "score"), weights, "score_").collect()
    assert len(rows) == len(cases.rows()) and all(0 < r.score_ < 1 and r.score == "y" for r in rows)
    empty = {r.score_ for r in rows if r.text is None or not r.text.strip(" \t\n\x0b\x0c\r")}
    assert len(empty) == 1
    assert quality.score(cases.empty(spark), weights, "p").count() == 0
    untrained = quality.train(docs, cases.labels(spark).where("false"), F.lit(True))
    assert {r.p for r in quality.score(docs.select("text"), untrained, "p").collect()} == {0.5}


def plain_slots(text: bytes) -> list[int]:
    """Features of one text, a word at a time, in whole numbers."""
    full, mix = (1 << 64) - 1, int(quality._MIX)

    def slot(value, salt):
        mixed = ((value + salt) & full) * mix & full
        mixed ^= mixed >> 29
        return (mixed * mix & full) >> (64 - quality.BITS)

    out, before = [], (1, 1)
    for word in text.split():
        both = quality._two_hashes(word)
        own, shape = both >> 32, both & 0xFFFFFFFF
        repeat = 1 << 40 if own == before[0] else 0
        out += [slot(own, 11), slot(shape, 22), slot((own * 31 + before[0]) & full, 33), slot((shape * 31 + before[1] + repeat) & full, 44)]
        before = (own, shape)
    return out


def test_quality_scores_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 2000)
    weights = np.random.default_rng(3).normal(0, 20, (1 << quality.BITS) + 1).astype(np.float32)
    docs = cases.documents(spark).where("doc_id is not null")
    got = sorted((r.doc_id, r.text or "", r.p) for r in quality.score(docs, weights, "p").collect())
    want = []
    for doc_id, text in ((r[0], r[1] or "") for r in cases.rows() if r[0] is not None):
        slots = plain_slots(text.encode())
        logit = float(weights[-1]) + (sum(float(weights[s]) for s in slots) / (len(slots) // 4) if slots else 0.0)
        want.append((doc_id, text, 1 / (1 + np.exp(-logit))))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-5)


def test_ftrl_separates():
    rows = [(np.array([i % 2], "<u4").tobytes(), np.array([1.0], "<f4").tobytes(), 1, i % 2) for i in range(200)]
    w = quality.fit(rows)
    assert w[0] < 0 < w[1] and np.count_nonzero(w) <= 3


def test_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, labels = [b"abc", b"de", b"q"], np.array([0, 1, 1])

    def loss():
        codes, real = net.batch(words)
        p = net.probabilities(codes)
        return -(np.log(p[:, np.arange(3), labels]) * real).sum() / real.sum()

    for k, g in net.gradients(words, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, eps = net.w[k][at], 1e-4
        net.w[k][at] = was + eps
        up = loss()
        net.w[k][at] = was - eps
        down = loss()
        net.w[k][at] = was
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=2e-2, abs=1e-5)


def plain_probabilities(network, word: bytes) -> np.ndarray:
    """Both passes over one word, a number at a time."""
    h, w, codes = langid.HIDDEN, network.w, [256, *word, 256]
    states = {}
    for d in "fb":
        state, out = [0.0] * h, {}
        for t in range(len(codes)) if d == "f" else reversed(range(len(codes))):
            x = [float(w[f"in_{d}"][codes[t], k] + w[f"bias_{d}"][k]) for k in range(3 * h)]
            rec = w[f"rec_{d}"].astype(float)
            gate = [1 / (1 + np.exp(-(x[k] + sum(state[i] * rec[i, k] for i in range(h))))) for k in range(2 * h)]
            z, r = gate[:h], gate[h:]
            new = [np.tanh(x[2 * h + k] + sum(r[i] * state[i] * rec[i, 2 * h + k] for i in range(h))) for k in range(h)]
            state = [z[k] * state[k] + (1 - z[k]) * new[k] for k in range(h)]
            out[t] = state
        states[d] = out
    rows = []
    for t in range(1, len(codes) - 1):
        both = states["f"][t] + states["b"][t]
        logits = np.array([sum(both[i] * float(w["out"][i, k]) for i in range(2 * h)) + float(w["out_bias"][k]) for k in range(len(network.languages))])
        e = np.exp(logits - logits.max())
        rows.append(e / e.sum())
    return np.array(rows)


def test_forward_pass_is_that_of_a_plain_loop():
    network = langid.Network(["a", "b", "c"], seed=2)
    words = [b"x", b"river", "größe".encode(), b"internationalisation"]
    codes, real = network.batch(words)
    got = network.probabilities(codes)
    for i, word in enumerate(words):
        assert np.allclose(got[real[:, i], i], plain_probabilities(network, word), atol=1e-4)


def test_language_on_held_out_documents(spark):
    got = {r.doc_id: r for r in langid.op6_langid(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [got[i].lang_pred == lang for i, lang in truth.items() if got[i].held_out and lang is not None]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    docs = cases.documents(spark)
    net = langid.train(docs.select("doc_id", "text", "lang"), langid.may_learn(F.col("doc_id")), steps=20)
    rows = langid.identify(docs, net).collect()
    assert len(rows) == len(cases.rows())
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (60, 61, 62))
    assert {by_id[i].lang_pred for i in (1, 65, 66, 70)} <= {"de", "en", "fr"}
    assert langid.identify(cases.empty(spark), net).count() == 0
    nothing = langid.train(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_reader_forgets_and_agrees(monkeypatch):
    net = langid.Network(["a", "b", "c"])
    texts = [cases.text(i, 30).encode() for i in range(10)] + [b"", b"z" * 500]
    want = langid.Reader(net).documents(texts)
    monkeypatch.setattr(langid, "REMEMBERED", 5)
    again = langid.Reader(net)
    assert np.allclose(np.concatenate([again.documents([t]) for t in texts]), want, atol=1e-5)


def brute(x: np.ndarray, ids: np.ndarray, query: int, k: int):
    v = x[np.flatnonzero(ids == query)[0]]
    d = np.sqrt(((x - v) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PART", 300)
    monkeypatch.setattr(ann, "ROW_BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.op3_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        want, own = brute(x, ids, q, 10), sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [s for *_, s in own] == sorted(s for *_, s in own)
        exact = {int(i): d for i, d in brute(x, ids, q, len(ids))}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for i, _ in want})
    assert hits >= 0.9 * 10 * len(got)


def test_vectors_that_take_no_part_and_ties(spark):
    data = [(i, [float(i % 7), 1.0], "x") for i in range(100, 160)]
    data += [(i, [9.0, 9.0], "x") for i in range(1000, 1100)]  # one vector for many rows, queries among them
    data += [(1, None, "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [None, 1.0], "x"), (5, [1.0], "x"), (6, [float("inf"), 0.0], "x"), (7, [], "x")]
    data += [(None, [1.0, 1.0], "x"), (100, [2.0, 1.0], "x"), (101, [3.0, 1.0], "x")]
    data.append(data[0])
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, part string").repartition(3)
    got = ann.nearest(d, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {100, 1000}
    assert sorted(by[1000]) == [(i, 1000 + i, 0.0) for i in range(1, 11)]
    assert not {r.vec_id for r in got} & {1, 2, 3, 4, 5, 6, 7, None}
    assert all(v != 100 for _, v, _ in by[100])
    few = ann.nearest(d.where("vec_id in (100, 110, 1000)"), F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r.vec_id) for r in few.collect() if r.query_id == 1000) == [(1000, 100), (1000, 110)]
    assert ann.nearest(d.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 8)) + rng.integers(0, 4, (800, 1)) * 5
    graph = ann._neighbours(x, 6)
    label = ann.balanced_parts(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 111
    assert (label[graph] == label[:, None]).mean() > 0.4


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(i, f"{'abcdefgh'[i % 8] * 4} {'abcdefgh'[i % 8] * 3}", f"l{i % 8}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.train(d, F.col("doc_id") < 160, steps=150)
    assert net.languages == [f"l{i}" for i in range(8)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, net).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_long_runs_are_cut_between_characters_and_read_with_their_neighbours():
    for word in ("語" * 50 + "ab\U0001f600" * 20, "x" * 24, "é" * 13, "z" * 25):
        raw = word.encode()
        pieces = langid.spans(raw)
        assert b"".join(p[a:b] for p, a, b in pieces) == raw and all(b - a <= langid.SPAN for _, a, b in pieces)
        for p, a, b in pieces:
            assert p.decode() and p[a:b].decode()
        assert all(a > 0 for _, a, _ in pieces[1:]) and all(b < len(p) for p, _, b in pieces[:-1])
    assert sum(b - a for _, a, b in langid.spans(b"\x80" * 100)) == 100
    net, run = langid.Network(["a", "b"]), b"q" * 24 + b"w" * 24
    alone = langid.Reader(net).documents([b"q" * 24])
    assert not np.allclose(net.word_sums(langid.spans(run)[:1]) / 24, alone, atol=1e-7)
