"""Gates, memory model, benchmark statistics and dataset hashes on hand-worked values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.operators import benchstats as B
from quirefold.operators import datasets as D
from quirefold.operators import gates as G
from quirefold.operators import memory as M

METRICS = "candidate string, ref_map double, cand_map double, ref_shift double, cand_shift double, agreement double, peak_bytes long, provenance_ok boolean"
AP = "candidate string, label string, ref_ap double, cand_ap double"


def verdicts(spark, rows, ap=()):
    m = spark.createDataFrame(rows, METRICS)
    d = G.class_drops(spark.createDataFrame(list(ap), AP), ["candidate"])
    return {(r.candidate, r.gate[:2]): r.passed for r in G.gate_verdicts(m, d, ["candidate"]).collect()}


def test_gate_boundaries(spark):
    got = verdicts(spark, [
        ("a", 0.50, 0.49, 0.5, 0.485, 0.98, 4 * 2**30, True), ("b", 0.5, 0.485, 0.5, 0.47, 0.9799, 4 * 2**30 + 1, False), ("c", 0.5, 0.5, 0.5, 0.5, None, None, True)])
    assert not got["a", "G1"]  # 0.50 - 0.49 exceeds 0.010 in double arithmetic
    assert got["a", "G2"] and got["a", "G4"] and got["a", "G5"] and got["a", "G6"] and got["a", "G3"]
    assert not any(got["b", g] for g in ("G1", "G2", "G4", "G5", "G6"))
    assert got["c", "G4"] and got["c", "G5"]


def test_critical_classes(spark):
    same = ("x", 0.5, 0.5, 0.5, 0.5, None, None, True)
    rows = [(c, *same[1:]) for c in ("vanished", "unseen", "minor", "drop", "hold")]
    got = verdicts(spark, rows, [("vanished", "table", 0.4, None), ("unseen", "table", None, 0.1), ("minor", "code", 0.9, 0.1), ("drop", "text", 0.5, 0.46), ("hold", "text", 0.5, 0.48)])
    assert [got[c, "G3"] for c in ("vanished", "unseen", "minor", "drop", "hold")] == [False, True, True, False, True]


def test_summary_and_negative_control(spark):
    v = spark.createDataFrame([("a", "G2_quality_shift", False), ("a", "G1_quality_clean", False), ("b", "G1_quality_clean", True)], "candidate string, gate string, passed boolean")
    assert {r.candidate: r.summary for r in G.gate_summary(v, ["candidate"]).collect()} == {"a": "failed:G1_quality_clean,G2_quality_shift", "b": "passed"}
    assert {r.candidate: r.blocked for r in G.negative_control_blocked(v, ["candidate"]).collect()} == {"a": True, "b": False}


def test_replay_puts_the_seed_before_the_first_promote(spark):
    rows = [("w", "ch", "r0", "seed", 1), ("w", "ch", "r1", "promote", 1), ("w", "ch", "r2", "promote", 2), ("w", "ch", "r3", "rollback", 3)]
    log = spark.createDataFrame(rows, "ws string, channel_id string, id string, action string, channel_version long")
    assert G.channel_replay(log).first().active_release_id == "r3"
    assert G.channel_replay(log.where("channel_version = 1")).first().active_release_id == "r1"
    assert G.version_conflicts(log).isEmpty()
    again = log.union(spark.createDataFrame([("w", "ch", "r9", "promote", 3)], log.schema))
    assert G.version_conflicts(again).first().n == 2


def fits(spark, samples):
    return M.fit_memory(spark.createDataFrame([("h", b, p) for b, p in samples.items()], "host string, batch int, peak long"), ["host"])


def test_reported_memory_fit(spark):
    r = fits(spark, {1: 81920, 2: 0, 4: 0, 8: 128909312}).first()
    assert (r.m0, round(r.m_item, 1), round(r.max_residual, 1), r.valid) == (-39183404, 19048323.3, 37009888.8, False)
    one = fits(spark, {4: 1000}).first()
    assert (one.m0, one.m_item, one.max_residual) == (900, 100.0, 100.0)


def test_admission(spark):
    mb = 1_000_000
    line = fits(spark, {1: 200 * mb, 2: 300 * mb, 4: 500 * mb})
    ask = lambda req, room, pend, cap: line.select(M.admit(F.lit(req), F.lit(room * mb), F.lit(pend * mb), cap)).first()[0]
    assert ask(4, 300, 0, 4) == 2 and ask(8, 1000, 400, 8) == 5 and ask(4, 150, 0, 4) == 0 and ask(4, 100, 100, 4) == 0
    bad = fits(spark, {1: 81920, 2: 0, 4: 0, 8: 128909312})
    assert bad.select(M.predict_peak(F.lit(2))).first()[0] == 128909312
    budget = spark.range(1).select(M.effective_budget(F.lit(K.WORKER_MEM_BUDGET))).first()[0]
    assert budget == 3650722201
    uncalibrated = line.select(M.admit(F.lit(9), F.lit(0), F.lit(0), 4, F.lit(False))).first()[0]
    assert uncalibrated == 4


def test_stability_of_the_published_trials(spark):
    """Throughputs of the committed trials: the batch-1 runtime trials pass, one trial alone does not."""
    rows = [("b1", 0, 4.639), ("b1", 1, 4.917), ("b1", 2, 4.931), ("alone", 0, 4.0), ("drifts", 0, 4.0), ("drifts", 1, 4.6)]
    out = {r.config: r for r in B.stability(spark.createDataFrame(rows, "config string, trial int, throughput double")).collect()}
    assert out["b1"].stable and out["b1"].cv == pytest.approx(0.0340, abs=2e-4) and out["b1"].drift == pytest.approx(0.0629, abs=2e-4)
    assert out["alone"].reasons == ["fewer than two trials"]
    assert out["drifts"].reasons == ["coefficient of variation", "first-to-last drift"]


def test_bootstrap_is_reproducible_and_covers_the_observed_range(spark):
    t = spark.createDataFrame([("c", i, v) for i, v in enumerate([231.09, 233.22, 244.78])] + [("one", 0, 5.0)], "config string, trial int, queue_inclusive_p95 double")
    a = {r.config: (r.ci_low, r.ci_high) for r in B.bootstrap_ci(t).collect()}
    assert a == {r.config: (r.ci_low, r.ci_high) for r in B.bootstrap_ci(t.repartition(3)).collect()}
    assert a == {"c": (231.09, 244.78), "one": (5.0, 5.0)}


def test_comparability_names_libraries(spark):
    env = "struct<cpu_brand:string,cpu_physical_cores:int,cpu_perf_levels:map<string,int>,mem_total_bytes:long,os_version:string,machine:string,library_versions:map<string,string>>"
    base = ("m", 8, None, 1, "1", None, {"torch": "2.1", "numpy": "1"})
    other = ("n", 8, None, 1, "1", None, {"torch": "2.2", "ort": "1"})
    df = spark.createDataFrame([(base, other), (base, base)], f"a {env}, b {env}")
    fields = [f for f in K.ENV_FIELDS if f != "cpu_perf_levels"]
    assert [r[0] for r in df.select(B.env_differences("a", "b", fields)).collect()] == [["cpu_brand", "library:numpy", "library:ort", "library:torch"], []]


def test_content_hashes_ignore_ids_and_see_order(spark, monkeypatch):
    monkeypatch.setattr(D, "FAN_IN", 4)
    rows = [(1, i, 9, float(i), 0.0, 5.0 + i, 5.0) for i in range(30)]
    layout = "page_id long, box_id long, class_id int, x1 double, y1 double, x2 double, y2 double"
    h = lambda rs, hot=10**6: D.annotation_hash(spark.createDataFrame(rs, layout).repartition(3), ["page_id"], [F.col("box_id")], hot).first().annotation_hash
    base = h(rows)
    assert base == h(rows, 0) == h([(1, r[1] + 100, *r[2:]) for r in rows]) == h([(*r[:3], r[3] + 0.0001, *r[4:]) for r in rows])
    assert base != h([(*r[:3], r[3] + 0.001, *r[4:]) for r in rows])
    assert base != h([(1, 29 - r[1], *r[2:]) for r in rows])


def test_the_manifest_makes_its_pages_once(spark):
    rows = [("d", i, f"s{i}", f"a{i}", "test") for i in range(9)]
    pages = spark.createDataFrame(rows, "dataset string, page_id long, page_sha string, annotation_hash string, split string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sha(sha(sha(",".join(sha("|".join(r[2:])) for r in rows))))
    for hot in (10**6, 0):
        out = D.manifest_hash(pages.repartition(3), ["dataset"], [F.col("page_id")], hot)
        assert [r.manifest_hash for r in out.collect()] == [want]
        # what is hashed was written before groups are measured and ranged
        assert "page_sha" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ink_rules(spark):
    img = np.full((40, 50, 3), 255, np.uint8)
    img[10:20, 10:20] = 0
    img[30:34, 30:34] = 0
    pages = spark.createDataFrame([("w", 1, 50, 40, bytearray(img.tobytes()))], "ws string, page_id long, width int, height int, rgb binary")
    boxes = [(1, 10, 10, 15, 20), (2, 15, 10, 20, 20), (3, 0, 0, 8, 8), (4, 29.5, 30, 34, 34), (5, 40, 0, 99, 9)]
    layout = "ws string, page_id long, box_id long, x1 double, y1 double, x2 double, y2 double"
    run = lambda bs: {(r.rule, r.box_id) for r in D.gt_ink_issues(pages, spark.createDataFrame([("w", 1, b[0], *map(float, b[1:])) for b in bs], layout), margin=5).collect()}
    assert run(boxes) == {("no_ink", 3)}
    assert run(boxes[:3]) == {("no_ink", 3), ("ink_uncovered", -1)}


def test_ink_of_a_page_with_very_many_boxes(spark):
    """A hundred thousand boxes on one page, beside small pages, against sums over the pixels themselves."""
    rng = np.random.default_rng(4)
    sizes = {1: (300, 200), 2: (20, 30), 3: (5, 5), 4: (40, 40)}
    images = {p: np.where(rng.random((h, w, 1)) < 0.02, 0, 255).astype(np.uint8).repeat(3, 2) for p, (w, h) in sizes.items()}
    pages = spark.createDataFrame([("w", p, w, h, bytearray(images[p].tobytes())) for p, (w, h) in sizes.items()], "ws string, page_id long, width int, height int, rgb binary")
    n = 100_000
    made = spark.range(n).selectExpr("'w' AS ws", "1L AS page_id", "id AS box_id", "CAST(id % 90 AS DOUBLE) AS x1", "CAST(id % 150 + 0.5 AS DOUBLE) AS y1", "CAST(id % 90 + 1 + id % 37 AS DOUBLE) AS x2", "CAST(id % 150 + 1 + id % 41 AS DOUBLE) AS y2")
    few = spark.createDataFrame([("w", 2, 1, 0.0, 0.0, 20.0, 15.0), ("w", 2, 2, -1.0, 0.0, 20.0, 15.0), ("w", 9, 1, 0.0, 0.0, 1.0, 1.0), ("w", 4, 7, 0.0, 0.0, 99.0, 1.0)], made.schema)
    got = {(r.page_id, r.rule, r.box_id): r.share for r in D.gt_ink_issues(pages, made.unionByName(few), margin=3).collect()}
    want = {}
    ink = {p: i.mean(axis=2) < K.INK_LEVEL for p, i in images.items()}
    covered = {p: np.zeros_like(i) for p, i in ink.items()}
    for r in [tuple(x)[1:] for x in made.unionByName(few).collect()]:
        p, box, x1, y1, x2, y2 = r
        if p in sizes and 0 <= x1 < x2 <= sizes[p][0] and 0 <= y1 < y2 <= sizes[p][1]:
            cut = np.s_[int(y1):int(np.ceil(y2)), int(x1):int(np.ceil(x2))]
            covered[p][cut] = True
            if (share := ink[p][cut].mean()) < K.MIN_INK_FRACTION:
                want[p, "no_ink", box] = share
    for p in (1, 2, 4):
        inner = np.s_[3:-3, 3:-3]
        total = ink[p][inner].sum()
        if total and (share := (ink[p] & covered[p])[inner].sum() / total) < K.MIN_INK_COVERAGE:
            want[p, "ink_uncovered", -1] = share
    assert got == pytest.approx(want) and len(want) > 100 and (4, "ink_uncovered", -1) in want


def test_missing_dataset_fails(spark):
    t = spark.createDataFrame([("synth-clean",)], "dataset string")
    with pytest.raises(D.MissingDataset):
        D.require_dataset(t, ["synth-clean", "synth-scan"])
