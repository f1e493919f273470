"""Near-equal documents: the n-gram join, its parts, and fingerprints."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import fingerprint, ngramjoin
from quirefold.llm.components import components
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def plain_components(texts: dict) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def corpus(seed=1):
    """Families of edited copies around the threshold, a passage that many share, chains, short texts."""
    r, out = random.Random(seed), {}

    def add(words):
        out[len(out) * 3 + 1] = " ".join(words)

    common = [f"p{i}" for i in range(60)]
    for family in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([12, 40, 150, 400]))]
        for copy in range(r.choice([2, 5, 30])):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 25)):
                words[r.randrange(len(words))] = f"e{r.randrange(10_000)}"
            add(words)
    for i in range(90):
        add([f"u{i}_{j}" for j in range(25)] + common + [f"v{i}_{j}" for j in range(10)])
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # each links with the next, not with the far ones
        add(chain[i * 6 : i * 6 + 120])
    for words in (["a"], ["A"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], []):
        add(words)
    return out


@pytest.mark.parametrize("few", [64, 2])
def test_join_matches_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(ngramjoin, "FEW", few)  # the tree on small cells as well
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    monkeypatch.setattr(ngramjoin, "VERIFY", 3)
    texts = corpus()
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.ngram_join(d).collect()}
    assert got == plain_components(texts)


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROUTES", 0)
    texts = dict(list(corpus(2).items())[:120])
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.ngram_join(d).collect()} == plain_components(texts)


def test_odd_rows(spark):
    rows = ngramjoin.ngram_join(cases.documents(spark)).collect()
    assert len(rows) == len(cases.rows())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert [by[i] for i in (60, 61, 62)] == [{(0, i)} for i in (60, 61, 62)]
    assert by[63] == {(1, 63)} and by[64] == {(1, 63)}
    assert {c for i in range(40, 60) for _, c in by[i]} == {40}
    assert {c for _, c in by[None]} == {None}
    assert by[71] == {(76, 71)}
    assert ngramjoin.ngram_join(cases.empty(spark)).count() == 0


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=8, max_size=8), st.integers(0, 3)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_tree_keeps_every_pair_within_the_bound(points):
    counts = np.array([c for c, _ in points])
    n, group = counts.sum(axis=1), np.array([g for _, g in points])
    got = {tuple(sorted(p)) for p in ngramjoin.tree_pairs(counts, n, group, 80).tolist()}
    want = {
        (i, j)
        for i, j in combinations(range(len(points)), 2)
        if group[i] != group[j]
        and np.minimum(counts[i], counts[j]).sum() >= -(-80 * (n[i] + n[j]) // 180)
        and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
    }
    assert got == want


def test_points_fold_to_fewer_groups():
    s = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    raw = ngramjoin._point(s).tobytes()
    assert len(raw) == 65536
    assert ngramjoin._folded(raw, 64).tolist() == np.bincount((s & np.uint64(63)).astype(int), minlength=64).tolist()
    crowded = ngramjoin._point(np.arange(300, dtype=np.uint64) << np.uint64(20))
    assert crowded[0] == 255 and ngramjoin._folded(crowded.tobytes()).sum() > 300  # never less than the overlap


def test_components_of_a_star_a_path_and_a_cycle(spark):
    links = [(1000, i) for i in range(500)] + [(i, i + 1) for i in range(2000, 2060)] + [(3000, 3001), (3001, 3002), (3002, 3000), (3005, 3005)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {**{i: 0 for i in [*range(1, 500), 1000]}, **{i: 2000 for i in range(2001, 2061)}, 3001: 3000, 3002: 3000}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def neighbours(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    return [(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_fingerprints_with_the_next_document(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint.fingerprint_with_next(cases.documents(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = []
    for d, t, n in neighbours(cases.rows()):
        half = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    assert by[40].fingerprint == by[44].fingerprint and by[60].fingerprint == by[61].fingerprint == "0" * 64
    assert by[60].near_next == 1.0 and by[60].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprint.fingerprint_with_next(cases.documents(spark).where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.fingerprint_with_next(cases.empty(spark)).count() == 0


def test_likeness_falls_with_edits():
    r = random.Random(5)
    texts = [cases.text(i, 400) for i in range(30)]

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            at = r.randrange(len(t))
            t[at : at + r.randrange(2)] = r.choice(["", "q"])
        return "".join(t)

    near = [fingerprint.likeness(fingerprint.prints(texts), fingerprint.prints([edit(t, n) for t in texts])).mean() for n in (0, 3, 30, 300)]
    other = fingerprint.likeness(fingerprint.prints(texts), fingerprint.prints(texts[1:] + texts[:1])).mean()
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.85 > 0.5 > other


def test_batches_do_not_change_prints(monkeypatch):
    texts = [cases.text(i, 50 + 40 * i) for i in range(12)] + ["", "x" * 30_000]
    want = fingerprint.prints(texts)
    monkeypatch.setattr(fingerprint, "TOGETHER", 500)
    assert (fingerprint.prints(texts) == want).all()


def plain_print(text):
    """The walks of one text, a character at a time."""
    move, vote = fingerprint._tables()
    classes = [(ord(c) + (ord(c) >> 8) * 37) % 255 + 1 for c in text]
    short = 0 < len(classes) < fingerprint.SHORT
    sums = [0] * fingerprint.BITS
    for r in range(-(-fingerprint.SHORT // len(classes)) if short else 1):
        for stretch, at in enumerate(range(0, len(classes), fingerprint.STRETCH)):
            piece, here, step = classes[at : at + fingerprint.STRETCH], 0, 0
            while here < len(piece):
                seen = fingerprint._turns()[r][piece[here]]
                sums[(step + 53 * (stretch + r)) % fingerprint.BITS] += int(vote[step % fingerprint.PERIOD][seen])
                here += int(move[step % fingerprint.PERIOD][seen])
                step += 1
    return np.packbits(np.array(sums) > 0)


def test_prints_are_those_of_a_plain_walk():
    texts = ["", "a", "abab", "é\U0001f600 x", cases.text(3, 40), cases.text(4, 900), cases.text(5, 3000)]
    got = fingerprint.prints(texts)
    assert all((g == plain_print(t)).all() for g, t in zip(got, texts))


def test_short_texts_are_not_alike_for_being_short():
    texts = [cases.text(i, 3) for i in range(60)] + ["a", "b", "ab", "abab", "7"]
    prints = fingerprint.prints(texts)
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] != texts[j]]
    near = fingerprint.likeness(prints[[i for i, _ in pairs]], prints[[j for _, j in pairs]])
    assert (near >= fingerprint.SIMILAR).mean() < 0.01


def families(seed, groups, size, flips, alone):
    """Prints of groups of copies that differ from their first one in up to ``flips`` bits, and unrelated ones."""
    r = np.random.default_rng(seed)
    first = r.integers(0, 2, (groups, 1, fingerprint.BITS), np.uint8)
    bits = np.repeat(first, size, axis=1)
    for g in range(groups):
        for k in range(1, size):
            at = r.choice(fingerprint.BITS, r.integers(1, flips + 1), replace=False)
            bits[g, k, at] ^= 1
    bits = np.concatenate([bits.reshape(-1, fingerprint.BITS), r.integers(0, 2, (alone, fingerprint.BITS), np.uint8)])
    return np.packbits(bits[r.permutation(len(bits))], axis=1)


def brute_pairs(prints):
    words, out = np.ascontiguousarray(prints).view("<u8"), []
    for at in range(0, len(words), 200):
        differ = np.bitwise_count(words[at : at + 200, None] ^ words[None]).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero(np.cos(np.pi * differ / fingerprint.BITS) >= fingerprint.SIMILAR)
        out.append(np.stack([x + at, y], axis=1)[x + at < y])
    return np.concatenate(out)


def brute_components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def searched(spark, prints):
    table = spark.createDataFrame([(i, p.tobytes().hex()) for i, p in enumerate(prints)], "doc_id bigint, fingerprint string").repartition(6)
    found = fingerprint.near_copies(table).collect()
    assert len(found) == len({p.tobytes() for p in prints})
    by = {r.fingerprint: r.component_id for r in found}
    return [by[p.tobytes().hex()] for p in prints]


def test_recall_of_near_copies_among_20_000_prints(spark):
    prints = families(1, 1500, 2, 52, 17_000)
    pairs = brute_pairs(prints)
    got = searched(spark, prints)
    assert len(pairs) >= 1500
    assert np.mean([got[a] == got[b] for a, b in pairs.tolist()]) >= 0.95
    want = brute_components(len(prints), pairs)
    assert all(want[i] == want[g] for i, g in enumerate(got))  # nothing is joined that has no chain of near pairs


def test_crowded_cells_lose_no_pair_between_blocks(spark, monkeypatch):
    prints = np.concatenate([families(2, 3, 400, 20, 0), families(3, 150, 4, 20, 300)])
    want = brute_components(len(prints), brute_pairs(prints))
    monkeypatch.setattr(fingerprint, "BLOCK", 40)
    assert searched(spark, prints) == want


def test_a_cell_full_of_copies_stays_linear(monkeypatch):
    compared = []
    plain = fingerprint._differ
    monkeypatch.setattr(fingerprint, "_differ", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    prints = np.ascontiguousarray(families(4, 1, 8_000, 12, 500)).view("<u8")
    x, _ = fingerprint.united(prints, np.arange(len(prints)))
    assert len(x) == 7_999 and sum(compared) < 8_500**2 / 8


def test_components_of_fingerprinted_documents(spark):
    rows = fingerprint.fingerprints(cases.documents(spark)).collect()
    assert len(rows) == len(cases.rows())
    by = {r.doc_id: r.component_id for r in rows}
    assert by[None] is None and {by[i] for i in range(40, 60, 4)} == {40} and sum(by[i] == 40 for i in range(40, 60)) >= 16
    assert all(by[i] == i for i in range(40) if i not in (1, 3, 7, 8)) and by[60] == by[61] == 60
    assert fingerprint.fingerprints(cases.empty(spark)).count() == 0
