"""Running totals and exact ranks; ``hot_rows=0`` forces the range-partitioned path."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quirefold.operators import ordering as O


@pytest.mark.parametrize("hot_rows", [10**6, 0])
def test_running_sums(spark, hot_rows):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i % 7, i, rng.randrange(9)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    got = {(r.g, r.i): (r.pos, r.total) for r in O.running_sums(df, ["g"], [F.col("i")], {"pos": F.lit(1), "total": F.col("v")}, hot_rows).collect()}
    seen = {}
    for g, i, v in sorted(rows):
        n, t = seen.get(g, (0, 0))
        seen[g] = (n + 1, t + v)
        assert got[g, i] == seen[g]


@pytest.mark.parametrize("limit", [O.RANK_ROWS, 50, 0])
def test_ranked_values_are_exact(spark, limit):
    rng = random.Random(2)
    data = {g: [round(rng.expovariate(0.01), 2) if g % 2 else float(rng.randrange(4)) for _ in range(n)] for g, n in enumerate([1, 2, 3, 20, 301, 1000])}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g long, v double")
    ranks = {"p50": O.nearest_rank(0.5), "p95": O.nearest_rank(0.95), "r50": O.rounded_rank(0.5), "r95": O.rounded_rank(0.95)}
    for r in O.ranked_values(df, ["g"], "v", ranks, limit).collect():
        s = sorted(data[r.g])
        n = len(s)
        assert r.n == n
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            assert r[name] == s[max(0, math.ceil(p * n) - 1)]
        for name, p in (("r50", 0.5), ("r95", 0.95)):
            assert r[name] == s[min(n - 1, max(0, round(p * (n - 1))))]


def test_bits_have_the_order_of_the_values(spark):
    edge = [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1e-310, 1.0, 1.0 + 2**-52, 2.0 - 2**-52, 2.0, 3.5, 1e300, 1.7976931348623157e308, math.inf]
    rng = random.Random(3)
    values = [*edge, *[-v for v in edge], *[rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)], *[2.0**e for e in range(-1074, 1024, 7)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", O.ordered_bits(F.col("v")).alias("b")).collect()
    for r in got:
        want = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-want if r.v < 0 else want), r.v
    nan = spark.range(1).select(O.ordered_bits(F.lit(float("nan"))).alias("b"), O.ordered_bits(F.lit(math.inf)).alias("i")).first()
    assert nan.b > nan.i


def test_ranks_of_a_crowded_group_with_an_outlier(spark, monkeypatch):
    """Values within a millionth and one far away: no bucket that is sorted holds more than the bound."""
    bound, sorted_rows = 500, []
    df = spark.range(60_000).select(F.lit(1).alias("g"), (1.0 + F.col("id") / 60_000 * 1e-6).alias("v")).union(spark.createDataFrame([(1, 1e12), (1, -3.0), (2, 7.0)], "g int, v double"))
    seen = O.materialize

    def watched(frame):
        kept = seen(frame)
        if "_rows" in kept.columns:
            sorted_rows.append(kept.where("g = 1").agg(F.max("_rows")).first()[0])
        return kept

    monkeypatch.setattr(O, "materialize", watched)
    ranks = {"p50": O.nearest_rank(0.5), "r95": O.rounded_rank(0.95), "least": F.lit(0), "most": F.col("n") - 1}
    got = {r.g: r for r in O.ranked_values(df, ["g"], "v", ranks, bound).collect()}
    values = sorted([1.0 + i / 60_000 * 1e-6 for i in range(60_000)] + [1e12, -3.0])
    n = len(values)
    assert (got[1].n, got[1].least, got[1].most) == (n, -3.0, 1e12)
    assert (got[1].p50, got[1].r95) == (values[math.ceil(0.5 * n) - 1], values[round(0.95 * (n - 1))])
    assert got[2].p50 == 7.0 and sorted_rows[0] == n and sorted_rows[-1] <= bound and len(sorted_rows) <= 5
