import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes: dict, weights=(5.0, 2.0, 1.0), most=3.0) -> dict:
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.mix(cases.documents(spark)).select("row.doc_id", "size", "source_size", "target", "taken", "position").collect()


def test_targets_and_sizes(mixed):
    sizes, ids = defaultdict(int), {}
    for doc_id, text, _, source, *_ in cases.rows():
        sizes[source] += len(WORD.findall(text or ""))
        ids.setdefault(doc_id, []).append((len(WORD.findall(text or "")), source))
    want = fill(sizes)
    assert len(mixed) == len(cases.rows())
    got = defaultdict(list)
    for r in mixed:
        got[r.doc_id].append(r.size)
        assert any(s == r.size and abs(want[src] - r.target) < 1e-6 and sizes[src] == r.source_size for s, src in ids[r.doc_id])
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(s for s, _ in v) for k, v in ids.items()}
    taken = defaultdict(int)
    for r in mixed:
        taken[round(r.target, 6)] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(want.values()), abs=len(want))


def test_training_order_cuts_one_document_of_a_source(spark):
    order = mixing.training_order(mixing.mix(cases.documents(spark), keep=["doc_id", "source", "text", "size"])).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    cut = [r for r in order if r.words < r.size]
    assert len(cut) == len({r.row.source for r in cut})
    again = mixing.training_order(mixing.mix(cases.documents(spark).repartition(2), keep=["doc_id", "source", "text", "size"])).collect()
    assert order == again


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 0.99])
def test_inverse_demand_undoes_the_integral(spark, share):
    for cls in range(3):
        t = spark.range(1).select(F.expr(mixing.inverse_demand(f"{share}e0", str(cls)))).first()[0]
        knots = [(k, m[cls]) for k, m in mixing.SCHEDULE]
        met = whole = 0.0
        for (a, m), (b, n) in zip(knots, knots[1:]):
            u = min(1.0, max(0.0, (t - a) / (b - a)))
            met += (b - a) * (m * u + (n - m) * u * u / 2)
            whole += (b - a) * (m + n) / 2
        assert met / whole == pytest.approx(share, abs=1e-9)


def test_first_words(spark):
    d = spark.createDataFrame([(" a  b\tc", 2), ("a b", 5), ("", 1)], "t string, n int")
    assert [r[0] for r in d.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b", "a b", ""]


def test_empty_table(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_sql(spark, tmp_path):
    cases.documents(spark).select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP1_SQL).fetchall()
    got = [tuple(r) for r in mixing.op1_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken", "position").collect()]
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
