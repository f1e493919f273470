import hashlib
import json
from collections import Counter

import numpy as np
import pytest

from quirefold.llm import alignment, perfect
from tests.llm import cases

MORE = [
    "a\n b\r\n{\r\n}  x", "tab\tand nbsp\xa0 here 　 wide", "trailing  ", " ", "  ", "\n", "it's they'll 've 123 4567", "<s>x</s><0x41><|endoftext|> <unk>",
    "low ▁ line", "▁", "\U0001f600\U0001f600 การ 中文字", "a\x00b \x1c c\x1d d", "x" * 5000 + " " + "中" * 3000, "é ﬁ Å", "one", "one two one two",
]


@pytest.fixture(scope="module")
def both():
    return alignment.Vocabularies(alignment.A, alignment.B)


def tokens(both, text):
    """Whole texts through the two libraries: (start, end, id) of each token, or nothing."""
    if not text:
        return [], []
    want, out = (" " + text).encode(), []
    signs = {c: b for c, b in alignment.byte_signs().items()}
    names = {i: e for e, i in both.a.get_vocab().items()}
    ids_a = both.a.encode(" " + text, add_special_tokens=False).ids
    ids_b = both.b.encode(text)
    raw_a = [bytes(signs[c] for c in names[i]) for i in ids_a]
    raw_b = []
    for i in ids_b:
        piece = both.b.id_to_piece(i)
        raw_b.append(bytes([int(piece[3:5], 16)]) if both.b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return [], []
    for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
        at, side = 0, []
        for i, r in zip(ids, raw):
            side.append((at, at + len(r), i))
            at += len(r)
        out.append(side)
    return tuple(out)


def plain(both, docs):
    sides = [tokens(both, t) for _, t in docs]
    links, counts = [], Counter()
    for a, b in sides:
        some, j = [], 0
        for s, e, i in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                some.append((i, b[k][2]))
                k += 1
        links.append(some)
        counts.update(some)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc_id, _), (a, b), some in zip(docs, sides, links):
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, i, j = [], 0, 0
        for end in ends:
            x, y = [], []
            while i < len(a) and a[i][1] <= end:
                x.append(str(a[i][2]))
                i += 1
            while j < len(b) and b[j][1] <= end:
                y.append(str(b[j][2]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        text = ";".join(groups)
        out.append((doc_id, len(a), len(b), len(ends), len(some), sum(counts[p] == best[p[1]] for p in some), sum(counts[p] for p in some), text))
    return out


def sample(spark):
    rows = cases.rows() + [(3000 + k, t, None, None, None, *cases.EXTRA) for k, t in enumerate(MORE)]
    return cases.documents(spark, rows), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 150])
def test_against_plain_loop(spark, both, slice_pairs, monkeypatch):
    docs, rows = sample(spark)
    got = alignment.align(docs, keep=["doc_id", "start"], slice_pairs=slice_pairs).collect()
    assert {r.row.start for r in got} == {"s"}
    mine = [(r.row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got]
    want = plain(both, rows)
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows))
    assert sorted(map(repr, mine)) == sorted(map(repr, want))


def test_query(spark, both, tmp_path):
    docs, rows = sample(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in alignment.op11_alignment(spark, str(tmp_path)).collect()]
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[1] else "") for w in plain(both, rows)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_table(spark):
    assert alignment.align(cases.empty(spark)).count() == 0
    assert alignment.align(cases.documents(spark, [(1, None, None, None, None, *cases.EXTRA)])).collect()[0].n_links == 0


def test_many_vectors_are_added_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 64)
    keys = np.random.default_rng(1).integers(0, 1 << 30, 40_000) // 200_000
    rows = [(int(k), 1 + i % 5) for i, k in enumerate(keys)]
    pairs = spark.createDataFrame(rows, "key bigint, n bigint").repartition(3 * alignment.FAN)
    want = Counter()
    for i, k in enumerate(keys):
        want[int(k)] += 1 + i % 5
    fields = [tuple(r) for r in alignment.hashed(pairs, 3).collect()]
    hash_ = perfect.PerfectHash(fields, 3)
    assert len(hash_) == len(want)
    blocks = alignment.count_vectors(pairs, spark.sparkContext.broadcast(hash_)).orderBy("block").collect()
    counts = np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in blocks])
    slots = hash_.slots(np.array(list(want)))
    assert sorted(slots) == list(range(len(want)))
    assert counts[slots].tolist() == list(want.values())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 20, n, replace=False) * 2000
    sizes, bits = perfect.build(keys)
    hash_ = perfect.PerfectHash([(0, sizes, bits)] if n else [], 1)
    assert sorted(hash_.slots(keys)) == list(range(n))
    assert len(bits) * 8 <= 4 * n + 64
    assert json.dumps(sizes)
