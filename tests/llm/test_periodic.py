import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import periodic
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, copies=3):
    """Every maximal stretch of every period; a stretch counts for its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= copies * q and (i, j - i + q) not in out:
                out[i, j - i + q] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items() if length >= max(least, copies * q))


def rewritten(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(doc_id, text):
    words = rewritten(doc_id, text)
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs))


def found(docs, **limits):
    words = np.array([w for d in docs for w in d], np.int64)
    bounds = np.cumsum([0, *map(len, docs)])
    runs = periodic.find_runs(words, bounds, **limits)
    of = np.searchsorted(bounds, runs[:, 0], "right") - 1
    return [[(int(s - bounds[d]), int(n), int(p)) for s, n, p in runs[of == d]] for d in range(len(docs))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_short_alphabets(docs):
    assert found(docs, least=1) == [plain_runs(d, 1) for d in docs]


@pytest.mark.parametrize("seed", range(40))
def test_planted_periods(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(4):
        root = [r.randrange(5) for _ in range(r.randrange(1, 50))]
        docs.append([r.randrange(5) for _ in range(r.randrange(30))] + (root * 9)[: r.randrange(1, 9 * len(root))] + [r.randrange(5)] * r.randrange(40))
    assert found(docs) == [plain_runs(d) for d in docs]


def table(spark):
    return cases.documents(spark, [row for row in cases.rows() if not row[1] or len(row[1]) < 150_000])


def test_query_against_plain_loop(spark, tmp_path):
    extra = [(i, cases.text(i % 5, 10 + i % 70), "en", "a", None, *cases.EXTRA) for i in range(1000, 1400)]
    extra += [(2000, "a " * 500, "en", "a", None, *cases.EXTRA), (2001, "a b\tc\n" * 40 + "d " * 30, "en", "a", None, *cases.EXTRA)]
    docs = table(spark).unionByName(cases.documents(spark, extra))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periodic.op12_periodic(spark, str(tmp_path)).collect()]
    want = [digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sum(w[1] > 0 for w in want) > 20
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_operator_keeps_texts_and_columns(spark):
    got = periodic.periodic_runs(table(spark), keep=["doc_id", "text", "start"]).collect()
    assert len(got) == table(spark).count()
    for r in got:
        words = WORD.findall(r.row.text or "")
        assert r.row.start == "s" and r.n_words == len(words)
        assert r.collapsed == collapsed(words, [tuple(x) for x in r.runs])


def test_very_long_text(spark):
    body = " ".join(f"w{i % 7}" for i in range(200_000)) + " end " + cases.text(4, 100_000)
    got = periodic.periodic_runs(cases.documents(spark, [(1, body, None, None, None, *cases.EXTRA)])).first()
    assert tuple(got.runs[0]) == (0, 200_000, 7)
    assert got.n_words == 300_001


def test_empty_table(spark):
    assert periodic.periodic_runs(cases.empty(spark)).count() == 0
