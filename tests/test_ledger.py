"""Ledger folds against plain loops, batch and streaming."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirefold.operators import ingest as I
from quirefold.operators import ledger as L
from quirefold.streaming import ledger as SL
from quirefold.streaming import ingest as SI
from quirefold.streaming import expiry, levels, store
from quirefold.streaming.runner import new_folder

EVENT = "ws string, item_id string, seq long, ts timestamp, kind string, worker string, token long, code string"
T0 = datetime(2024, 1, 1)
TERMINAL = {"complete": "succeeded", "fail": "failed", "cancel": "cancelled"}


def event_log(seed, n=400):
    rng = random.Random(seed)
    tokens, rows = {}, []
    for seq in range(n):
        item = "hot" if rng.random() < 0.4 else f"i{rng.randrange(12)}"
        kind = rng.choice(["claim", "claim", "heartbeat", "heartbeat", "complete", "fail", "cancel", "requeue"])
        if kind == "claim":
            tokens.setdefault(item, []).append(seq)
            token = seq
        else:
            token = rng.choice(tokens.get(item, [None])[-2:])
        rows.append(("w", item, seq, T0 + timedelta(seconds=seq * 7), kind, f"k{seq % 5}", token, "inference_failed" if kind == "fail" else None))
    return rows


def fold(rows):
    items, verdicts = {}, {}
    for ws, item, seq, ts, kind, worker, token, code in rows:
        s = items.setdefault(item, {"state": "queued", "attempts": 0, "token": None, "owner": None, "lease": None, "code": None})
        mine = s["token"] is not None and s["token"] == token
        if kind == "claim":
            s.update(state="running", attempts=s["attempts"] + 1, token=token, owner=worker, lease=ts + timedelta(seconds=60), code=None)
        elif kind == "requeue":
            s.update(state="queued", token=None, owner=None, lease=None, code=None)
        else:
            ok = mine and s["state"] == "running"
            verdicts[seq] = "accepted" if ok else "not_running" if mine else "stale_token"
            if ok and kind == "heartbeat":
                s["lease"] = max(s["lease"], ts + timedelta(seconds=60))
            elif ok:
                s.update(state=TERMINAL[kind], owner=None, lease=None, code=code if kind == "fail" else "cancelled" if kind == "cancel" else None)
    return items, verdicts


@pytest.mark.parametrize("hot_rows", [10**6, 0])
def test_event_log_against_a_plain_fold(spark, hot_rows):
    rows = event_log(4)
    items, verdicts = fold(rows)
    ev = spark.createDataFrame(rows, EVENT).repartition(3)
    got = {r.seq: r.verdict for r in L.fenced_writes(ev, hot_rows).collect()}
    assert got == {q: v for q, v in verdicts.items() if rows[q][4] in TERMINAL}
    for r in L.item_state_fold(ev, hot_rows=hot_rows).collect():
        s = items[r.item_id]
        assert (r.state, r.attempts, r.fencing_token, r.lease_owner, r.lease_expires_at, r.failure_code) == tuple(s.values())
    beats = L.lease_extend(ev, hot_rows=hot_rows).agg(F.sum("held")).first()[0]
    assert beats == sum(1 for q, v in verdicts.items() if v == "accepted" and rows[q][4] == "heartbeat")


def replay(spark, df, files, seed=1):
    """The rows as a stream of several triggers, in an order of their own."""
    path = new_folder(spark, "replay")
    for part in df.orderBy(F.rand(seed)).randomSplit([1.0] * files, seed):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_event_streams_in_any_order_equal_the_batch_folds(spark):
    ev = spark.createDataFrame(event_log(9, 200), EVENT)
    assert rows_of(SL.item_state_fold(replay(spark, ev, 3))) == rows_of(L.item_state_fold(ev))
    assert rows_of(SL.fenced_writes(replay(spark, ev, 3))) == rows_of(L.fenced_writes(ev))
    assert rows_of(SL.lease_extend(replay(spark, ev, 2))) == rows_of(L.lease_extend(ev))
    assert SL.item_state_fold(replay(spark, ev.limit(0), 1)).count() == 0


def test_first_of_each_key_has_no_horizon(spark):
    """A key comes back after ten days, another request is older than any watermark would allow."""
    rows = [("w", "k1", "b1", 1), ("w", "k2", "b2", 20), ("w", "k1", "b3", 11), ("w", "k3", "b4", 2), ("v", "k1", "b5", 3), ("w", None, "b6", 4), ("w", "k2", "b0", 20)]
    df = spark.createDataFrame(rows, "ws string, idempotency_key string, id string, day int").withColumn("created_at", F.expr("date_add(date'2026-01-01', day)").cast("timestamp"))
    for seed in (1, 2):
        got = {(r.ws, r.idempotency_key): r.id for r in SI.idempotent_batches(replay(spark, df, 4, seed)).collect()}
        assert got == {("w", "k1"): "b1", ("w", "k2"): "b0", ("w", "k3"): "b4", ("v", "k1"): "b5"}
    p = spark.createDataFrame([("w", "i", "c", "p2"), ("w", "i", "c", "p1"), ("w", "j", "c", "p3")], "ws string, work_item_id string, candidate_id string, id string")
    assert {r.id for r in SL.unique_predictions(replay(spark, p, 3)).collect()} == {"p1", "p3"}


def swept(events, now, lease_s=60, attempts=3):
    """The batch fold and then the sweep at one moment."""
    state = L.item_state_fold(events, lease_s).withColumns({"claimed_at": F.lit(None).cast("timestamp"), "outcome": F.lit(None).cast("string")})
    late = L.lease_sweep(state, F.lit(now), attempts)
    return state.join(late.select("ws", "item_id"), ["ws", "item_id"], "left_anti").unionByName(late).drop("claimed_at")


def arriving(spark, rows, files):
    """Events in several files, arrived in this order; the clock is the greatest time of those so far."""
    path, size, clock, seen = new_folder(spark, "arriving"), -(-len(rows) // files), T0, []
    for at in range(0, len(rows), size):
        part = rows[at:at + size]
        clock = max([clock, *[r[3] for r in part]])
        seen += [(*r, clock) for r in part]
        spark.createDataFrame(seen[at:], EVENT + ", seen_at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENT + ", seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return stream, clock


def test_leases_run_out_without_an_event_of_their_own(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    log = [
        ("w", "stops", 0, at(0), "claim", "k", 1, None), ("w", "stops", 1, at(30), "heartbeat", "k", 1, None),
        ("w", "third", 2, at(1), "claim", "k", 2, None), ("w", "third", 3, at(2), "claim", "k", 3, None), ("w", "third", 4, at(3), "claim", "k", 4, None),
        ("w", "done", 5, at(4), "claim", "k", 5, None), ("w", "done", 6, at(5), "complete", "k", 5, None),
        ("w", "edge", 7, at(140), "claim", "k", 7, None), ("w", "over", 10, at(139.999), "claim", "k", 10, None), ("w", "live", 8, at(190), "claim", "k", 8, None),
        ("w", "clock", 9, at(200), "claim", "k", 9, None),
    ]
    stream, clock = arriving(spark, log, 5)
    got = {r.item_id: (r.state, r.outcome, r.failure_code, r.fencing_token) for r in expiry.expiring_items(stream).collect()}
    assert clock == at(200)
    assert got == {
        "stops": ("queued", "requeued", None, None), "third": ("failed", "exhausted", "max_attempts", 4), "done": ("succeeded", None, None, 5),
        "edge": ("running", None, None, 7), "over": ("queued", "requeued", None, None), "live": ("running", None, None, 8), "clock": ("running", None, None, 9)}


@pytest.mark.parametrize("seed", [3, 8])
def test_expiring_items_equal_the_sweep_of_the_batch_fold(spark, seed):
    """Events out of order, some long after their item was swept."""
    log = event_log(seed, 220)
    late = log[:]
    random.Random(seed).shuffle(late)
    for rows in (log, late):
        stream, clock = arriving(spark, rows, 4)
        assert rows_of(expiry.expiring_items(stream)) == rows_of(swept(spark.createDataFrame(rows, EVENT), clock))


def test_levels_of_a_table_grow_with_the_logarithm_of_triggers(spark, monkeypatch):
    monkeypatch.setattr(levels, "FAN", 2)
    table = levels.LevelledTable(spark, new_folder(spark, "levels"), "k long, v long", ["k"])
    of = lambda n: spark.range(n * 10, n * 10 + 10).selectExpr("id AS k", f"CAST({n} AS BIGINT) AS v")
    for n in range(11):
        keys = spark.range(0, 5).selectExpr("id AS k")
        held = table.holding(keys, n)
        assert held.join(keys, "k", "left_semi").count() == (5 if n else 0)
        table.add(of(n), n)
        table.add(of(n), n)  # a trigger that is played again
    runs = table._runs()
    assert len(runs) <= 4 and max(r["level"] for r in runs) == 3
    # five keys in one run: only folders that may hold one of them are opened
    assert all(n <= 5 for n in table.opened)
    assert sorted(r.k for r in table.rows().collect()) == list(range(110))


def test_a_trigger_that_dies_before_its_manifest_leaves_nothing(spark, monkeypatch):
    ev = spark.createDataFrame(event_log(5, 120), EVENT)
    root, stream = new_folder(spark, "dies"), replay(spark, ev, 3)
    real, calls = levels.publish_document, []

    def dying(*args):
        calls.append(1)
        if len(calls) == 4:  # the results of the second trigger: its log is in already
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(levels, "publish_document", dying)
    with pytest.raises(Exception, match="lost"):
        store.refolded(stream, ("ws", "item_id"), L.item_state_fold, root)
    assert rows_of(store.refolded(stream, ("ws", "item_id"), L.item_state_fold, root)) == rows_of(L.item_state_fold(ev))


def test_upserts_write_the_groups_a_trigger_changed(spark):
    rows = [("w", f"b{i % 50}", "queued") for i in range(200)]
    path, root = new_folder(spark, "items"), new_folder(spark, "counts")
    layout = "ws string, batch_id string, state string"
    counts = lambda: store.upserted(L.state_counts(spark.readStream.schema(layout).parquet(path)), ["ws", "batch_id", "state"], root)
    spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(path)
    assert {r.n for r in counts().collect()} == {4}
    spark.createDataFrame([("w", "b7", "queued"), ("w", None, "queued")], layout).coalesce(1).write.mode("append").parquet(path)
    got = {r.batch_id: r.n for r in counts().collect()}
    assert got == {**{f"b{i}": 4 for i in range(50)}, "b7": 5, None: 1}
    table = levels.LevelledTable(spark, root, "ws string", ["ws"])
    assert [table._all([r]).count() for r in table._runs()] == [50, 2]


def test_micro_batches_over_triggers_keep_the_last_batch(spark):
    times = [i * 40 + (i % 7) * 13 for i in range(60)]
    path = new_folder(spark, "arrivals")
    rows = [("p" if i % 3 else "q", t, i) for i, t in enumerate(times)]
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i:i + 20], "pool string, at_ms long, item long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("pool string, at_ms long, item long").option("maxFilesPerTrigger", 1).parquet(path)
    want = L.micro_batches(spark.createDataFrame(rows, "pool string, at_ms long, item long"), 4, 300)
    assert rows_of(SL.micro_batches(stream, 4, 300)) == rows_of(want)


def batches_by_hand(times, size, window):
    out, cur, pos = [], [], 0
    for i, t in enumerate(times):
        cur.append(t)
        why = "size" if len(cur) >= size else "time" if t - cur[0] >= window else None
        if why:
            out.append((pos, len(cur), why, t - cur[0]))
            cur, pos = [], i + 1
    if cur:
        out.append((pos, len(cur), "flush", cur[-1] - cur[0]))
    return out


@pytest.mark.parametrize("size,window,chunk,hot_rows", [(4, 25, 7, 10**6), (1, 10, 5, 10**6), (5, 3, 11, 0), (3, 0, 4, 10**6), (8, 1000, 9, 10**6)])
def test_micro_batches_in_chunks(spark, size, window, chunk, hot_rows):
    rng = random.Random(size)
    pools = {}
    for p, n in (("a", 203), ("b", 1), ("c", 50)):
        t, pools[p] = 0, []
        for _ in range(n):
            t += rng.choice([0, 0, 1, 5, 30])
            pools[p].append(t)
    df = spark.createDataFrame([(p, t, i) for p, ts in pools.items() for i, t in enumerate(ts)], "pool string, at_ms long, item long")
    got = {}
    for r in L.micro_batches(df, size, window, chunk_rows=chunk, hot_rows=hot_rows).orderBy("pool", "start_pos").collect():
        got.setdefault(r.pool, []).append((r.start_pos, r.n, r.closed_by, r.waited_ms))
    assert got == {p: batches_by_hand(ts, size, window) for p, ts in pools.items()}


def test_rollup_ladder(spark):
    mixes = {"b1": ["running", "succeeded"], "b2": ["succeeded", "failed", "cancelled"], "b3": ["succeeded", "cancelled"], "b4": ["succeeded"], "b5": ["queued"], "b6": [], "b7": ["queued"]}
    items = spark.createDataFrame([("w", b, s) for b, ss in mixes.items() for s in ss], "ws string, batch_id string, state string")
    batches = spark.createDataFrame([("w", b, "queued", T0 if b == "b7" else None, None) for b in mixes] + [("w", "done", "failed", None, T0)],
                                    "ws string, id string, status string, cancel_requested_at timestamp, finished_at timestamp")
    got = {r.id: (r.status, r.finished_at is not None) for r in L.batch_rollup(batches, items, F.lit(T0)).collect()}
    assert got == {"b1": ("running", False), "b2": ("failed", True), "b3": ("partial", True), "b4": ("succeeded", True), "b5": ("queued", False), "b6": ("succeeded", True), "b7": ("cancelled", False)}


def test_lease_sweep_requeues_then_gives_up(spark):
    rows = [("i1", 1, T0), ("i2", 2, T0), ("i3", 3, T0), ("live", 1, T0 + timedelta(hours=2))]
    df = spark.createDataFrame([("w", i, "running", a, "k", e, 7, None, T0) for i, a, e in rows],
                               "ws string, id string, state string, attempts int, lease_owner string, lease_expires_at timestamp, fencing_token long, failure_code string, claimed_at timestamp")
    got = {r.id: (r.outcome, r.failure_code, r.fencing_token) for r in L.lease_sweep(df, F.lit(T0 + timedelta(hours=1))).collect()}
    assert got == {"i1": ("requeued", None, None), "i2": ("requeued", None, None), "i3": ("exhausted", "max_attempts", 7)}


def test_cancel_twice_changes_nothing_more(spark):
    b = spark.createDataFrame([("w", "b1", None)], "ws string, id string, cancel_requested_at timestamp")
    i = spark.createDataFrame([("w", "b1", "i1", "queued", None), ("w", "b1", "i2", "running", None)], "ws string, batch_id string, id string, state string, failure_code string")
    ask = spark.createDataFrame([("w", "b1", T0), ("w", "b1", T0 + timedelta(1))], "ws string, batch_id string, requested_at timestamp")
    marked, dropped = L.cancel_fanout(b, i, ask)
    assert marked.first().cancel_requested_at == T0 and [r.id for r in dropped.collect()] == ["i1"]
    left = i.join(dropped.select("id"), "id", "left_anti").select(*i.columns).unionByName(dropped)
    assert L.cancel_fanout(marked, left, ask)[1].isEmpty()


def test_orphans_keep_old_but_referenced_objects(spark):
    listing = spark.createDataFrame([("old", T0 - timedelta(2)), ("old-used", T0 - timedelta(2)), ("new", T0)], "key string, mtime timestamp")
    refs = spark.createDataFrame([("old-used",)], "object_key string")
    assert [r.key for r in L.orphan_objects(listing, refs, F.lit(T0)).collect()] == ["old"]


def test_hard_cap_is_strict_and_optional(spark):
    df = spark.createDataFrame([(5, 4), (4, 4), (5, 0), (None, 4)], "p long, c long")
    assert [r[0] for r in df.select(L.over_hard_cap(F.col("p"), F.col("c"))).collect()] == [True, False, False, False]


def test_registered_content_is_never_registered_again(spark):
    path, root = new_folder(spark, "uploads"), new_folder(spark, "assets")
    layout = "ws string, sha256 string, arrival long, id string"
    spark.createDataFrame([("w", "a", 1, "x1"), ("w", "a", 2, "x2"), ("v", "a", 3, "x3")], layout).coalesce(1).write.mode("append").parquet(path)
    known = spark.createDataFrame([("w", "z")], "ws string, sha256 string")
    stream = lambda: spark.readStream.schema(layout).parquet(path)
    assert {r.id for r in SI.register_assets(stream(), known, root).collect()} == {"x1", "x3"}
    spark.createDataFrame([("w", "a", 4, "x4"), ("w", "z", 5, "x5"), ("w", "b", 6, "x6")], layout).coalesce(1).write.mode("append").parquet(path)
    assert {r.id for r in SI.register_assets(stream(), known, root).collect()} == {"x1", "x3", "x6"}


def test_screen_order_of_batch_limits(spark):
    rows = [("w", "many", i, 1, 1) for i in range(51)] + [("w", "fat", 0, 26 * 2**20, 1), ("w", "long", 0, 1, 31), ("w", "fine", 0, 1, 1)]
    df = spark.createDataFrame(rows, "ws string, batch_id string, file_no int, byte_size long, pages int")
    got = {r.batch_id: r.verdict for r in I.batch_limit_verdict(df).collect()}
    assert got == {"many": "too_many_files", "fat": "file_too_large", "long": "file_has_too_many_pages", "fine": "ok"}
    assert {r.verdict for r in I.batch_limit_verdict(df.where("batch_id = 'fine'"), spark.createDataFrame([("w", 500)], "ws string, queued long")).collect()} == {"queue_full"}
