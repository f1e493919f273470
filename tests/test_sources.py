"""Byte probes, readers and writers."""

import hashlib
import json
import struct
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirefold.functions import hashing, times
from quirefold.functions.media import header_dims, sniff_media
from quirefold.operators import ingest as I
from quirefold.sources import commits, objects, readers, sinks
from quirefold.streaming.runner import new_folder


def jpeg(w, h, sof=0xC0, filler=b"\xff\xc4\x00\x04ab"):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + filler + bytes([0xFF, sof]) + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 10


def tiff(w, h, order="<", kind=3):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    entry = lambda tag, v: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
    return head + struct.pack(order + "H", 2) + entry(256, w) + entry(257, h)


CASES = {
    b"": ("empty", None),
    b"PK\x03\x04zip": ("unrecognised", None),
    b"%PDF-1.7 body": ("application/pdf", None),
    b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 50000, 50000): ("image/png", (50000, 50000)),
    b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">I", 7): ("image/png", None),
    jpeg(640, 480): ("image/jpeg", (640, 480)),
    jpeg(640, 480, 0xC2): ("image/jpeg", (640, 480)),
    jpeg(640, 480, 0xC4): ("image/jpeg", None),
    jpeg(640, 480, filler=b"\xff\xd9"): ("image/jpeg", None),
    jpeg(640, 480)[:12]: ("image/jpeg", None),
    tiff(300, 200): ("image/tiff", (300, 200)),
    tiff(300, 200, ">", 4): ("image/tiff", (300, 200)),
    tiff(300, 200)[:20]: ("image/tiff", None),
    b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (799).to_bytes(3, "little") + (599).to_bytes(3, "little"): ("image/webp", (800, 600)),
    b"GIF89a" + struct.pack("<HH", 20, 10): ("unrecognised", (20, 10)),
}


def test_container_bytes(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(CASES)], "i int, content binary")
    got = df.select("i", sniff_media(F.col("content")).alias("m"), header_dims(F.col("content")).alias("d")).orderBy("i").collect()
    assert [(r.m, (r.d.width, r.d.height) if r.d else None) for r in got] == list(CASES.values())


def test_screen_refuses_from_the_header_alone(spark):
    rows = [(0, bytearray(list(CASES)[3])), (1, bytearray(b"%PDF-1.7" + b"x" * 5000 + b"/Encrypt")), (2, bytearray(b"%PDF-1.7/Encrypt" + b"x" * 5000)), (3, bytearray(jpeg(10, 10))), (4, bytearray(b"PK"))]
    out = I.screen_uploads(spark.createDataFrame(rows, "n int, content binary"))
    assert "content" not in out.columns
    assert [r.failure_code for r in out.orderBy("n").collect()] == ["pixel_limit", "encrypted_pdf", None, None, "unsupported_type"]


def test_pixel_limit_boundary(spark):
    df = spark.createDataFrame([(8000, 5000), (8000, 5001), (0, 5), (50000, 50000)], "width long, height long")
    got = df.select(I.pixel_verdict(F.struct("width", "height")).alias("v")).collect()
    assert [r.v for r in got] == ["ok", "pixel_limit", "decode_failed", "pixel_limit"]


def test_unsafe_keys(spark):
    keys = ["", "/a", "a/../b", "a\\b", "a//b", "a/./b", "a/b.png", "assets/ab12"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    assert [r.u for r in df.select("i", I.unsafe_key(F.col("k")).alias("u")).orderBy("i").collect()] == [True] * 6 + [False] * 2


def test_object_listing(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "x.png").write_bytes(b"123")
    (tmp_path / "top").write_bytes(b"1")
    got = objects.object_listing(spark, str(tmp_path)).collect()
    assert {(r.key, r.size) for r in got} == {("pages/x.png", 3), ("top", 1)}
    assert all(abs(r.mtime.timestamp() - (tmp_path / r.key).stat().st_mtime) < 0.01 for r in got)
    assert objects.object_listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_objects_are_listed_by_prefix_in_tasks(spark, tmp_path):
    rows = [(f"{i % 7}/{i % 3}/o{i}", bytes(i)) for i in range(100)] + [("empty", b""), ("é/ü x", b"1")]
    objects.write_objects(spark.createDataFrame(rows, "key string, content binary").repartition(4), f"{tmp_path}/store")
    objects.write_objects(spark.createDataFrame(rows[:5], "key string, content binary"), f"{tmp_path}/store")  # a retry
    listed = objects.object_listing(spark, f"{tmp_path}/store")
    assert sorted((r.key, r.size) for r in listed.collect()) == sorted((k, len(c)) for k, c in rows)
    assert listed.select(F.spark_partition_id()).distinct().count() == 9  # a task for each prefix and one for the root


def test_new_objects_as_a_stream(spark, tmp_path):
    store, out = tmp_path / "store", new_folder(spark, "listed")
    one = spark.createDataFrame([(f"a/{i}", b"x") for i in range(5)], "key string, content binary")
    two = spark.createDataFrame([(f"b/{i}", b"xy") for i in range(3)], "key string, content binary")

    def drained() -> list[str]:
        time.sleep(1.2)  # the store's settling time
        query = (
            objects.object_listing(spark, str(store), stream=True).select("key", "size").writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(r.key for r in spark.read.schema("key string, size long").parquet(f"{out}/rows").collect())

    objects.write_objects(one, str(store))
    assert drained() == [f"a/{i}" for i in range(5)]
    objects.write_objects(two, str(store))
    assert drained() == [f"a/{i}" for i in range(5)] + [f"b/{i}" for i in range(3)]
    assert len(drained()) == 8


def test_trial_files(spark, tmp_path):
    sample = {"page_id": "p0", "queue_inclusive_ms": 2.5, "service_ms": 2.0, "preprocess_ms": 0.5, "infer_ms": 1.5, "postprocess_ms": 0.0, "peak_rss": 9}
    for trial in (0, 1):
        (tmp_path / f"m_t{trial}.json").write_text(json.dumps({"config": "m/b1", "trial": trial, "summary": {"n_pages": 2}, "samples": [sample, {**sample, "page_id": "p1"}]}, indent=2))
    got = readers.bench_samples(spark, str(tmp_path)).collect()
    assert sorted((r.trial, r.pos, r.page_id, r.service_ms) for r in got) == [(0, 0, "p0", 2.0), (0, 1, "p1", 2.0), (1, 0, "p0", 2.0), (1, 1, "p1", 2.0)]


def test_label_maps(spark):
    df = spark.createDataFrame([('{"id2label":{"0":"text","10":"title"}}',)], "config string")
    assert {(r.class_id, r.label) for r in readers.label_map(df, "config", [], check=True).collect()} == {(0, "text"), (10, "title")}
    with pytest.raises(readers.EmptyLabelMap):
        readers.label_map(spark.createDataFrame([('{"id2label":{}}',)], "config string"), "config", [], check=True)


def test_tables_keep_their_stored_names(spark, tmp_path):
    df = spark.createDataFrame([("c1", "w", "main", 3)], "id string, ws string, name string, version int")
    sinks.write_table(df, f"{tmp_path}/channel", "channel")
    assert "workspace_id" in spark.read.parquet(f"{tmp_path}/channel").columns
    back = readers.load_table(spark, str(tmp_path), "channel")
    assert back.first().ws == "w" and dict(back.dtypes)["version"] == "bigint"


def test_json_text_matches_the_json_module(spark):
    texts = ["", "plain", "é", "日本", "😀", 'q"b\\s', "\x00\x01\x1f\x7f\b\f\n\r\t", "a\u2028b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.json_text(F.col("t")))
    assert [r[0] for r in df.collect()] == [None if t is None else json.dumps(t) for t in texts]


@pytest.mark.parametrize("text, want", [
    ("2026-01-01 10:00:00.123456+00:00", "2026-01-01 10:00:00.123456"), ("2026-01-01 10:00:00+00", "2026-01-01 10:00:00"), ("2026-01-01T10:00", "2026-01-01 10:00:00"),
    ("2026-01-01T10:00:00.5-03:30", "2026-01-01 13:30:00.5"), ("2026-01-01", "2026-01-01 00:00:00"), ("2026-02-30 10:00:00", None), ("10:00", None), ("", None), (None, None),
])
def test_timestamp_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(times.coerce_ts(F.col("t"))).first()[0]
    assert got == (None if want is None else datetime.fromisoformat(want))


def test_object_keys_below_an_odd_root(spark, tmp_path):
    root = tmp_path / "a.b+c (1)"
    (root / "x").mkdir(parents=True)
    (root / "x" / "y.bin").write_bytes(b"12")
    for given in (str(root), f"file://{root}", f"file:{root}/"):
        assert [tuple(r) for r in objects.object_listing(spark, given).select("key", "size").collect()] == [("x/y.bin", 2)]


def test_stored_artifacts_are_hashed_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.onnx").write_bytes(b"weights")
    (tmp_path / "b.onnx").write_bytes(b"changed")
    files = I.stored_hashes(spark.read.format("binaryFile").load(str(tmp_path)))
    sha = hashlib.sha256(b"weights").hexdigest()
    rows = [("w", f"file:{tmp_path}/{n}.onnx", sha) for n in "abc"]
    verdicts = I.artifact_verify(spark.createDataFrame(rows, "ws string, path string, sha256 string"), files.withColumn("ws", F.lit("w")))
    assert {r.path[-6]: r.verdict for r in verdicts.collect()} == {"a": "ok", "b": "mismatch", "c": "missing"}


RELEASE = "id string, ws string, channel_id string, candidate_id string, action string, actor string, created_at timestamp"


def releases(spark, ids):
    return spark.createDataFrame([(i, "w", "ch", "c", "promote", "me", datetime(2026, 1, 1)) for i in ids], RELEASE)


def test_release_and_audit_rows_appear_together_and_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    ids = lambda t, c="id": sorted(r[0] for r in readers.release_log(spark, root, t).select(c).collect())
    assert ids("release") == []
    assert sinks.append_release_log(releases(spark, ["r1", "r2"]), root)
    assert not sinks.append_release_log(releases(spark, ["r2", "r1"]), root)
    assert (ids("release"), ids("audit_event", "after_hash")) == (["r1", "r2"], ["r1", "r2"])

    # the writer dies between the two tables, then between the tables and the manifest
    def broken(*_):
        raise OSError("lost")

    bad = releases(spark, ["r3"]).withColumn("actor", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_release_log(bad, root, "third")
    with monkeypatch.context() as m:
        m.setattr(commits, "publish_document", broken)
        with pytest.raises(OSError):
            sinks.append_release_log(releases(spark, ["r3"]), root, "third")
    assert (ids("release"), ids("audit_event", "after_hash")) == (["r1", "r2"], ["r1", "r2"])
    # the same append again
    assert sinks.append_release_log(releases(spark, ["r3"]), root, "third")
    assert not sinks.append_release_log(releases(spark, ["r3"]), root, "third")
    assert (ids("release"), ids("audit_event", "after_hash")) == (["r1", "r2", "r3"], ["r1", "r2", "r3"])


def test_a_published_document_is_not_replaced(spark, tmp_path):
    where = str(tmp_path / "d" / "one")
    assert commits.read_document(spark, where) is None and commits.names_in(spark, str(tmp_path / "d")) == []
    assert commits.publish_document(spark, where, {"a": 1})
    assert not commits.publish_document(spark, where, {"a": 2})
    assert commits.read_document(spark, where) == {"a": 1} and commits.names_in(spark, str(tmp_path / "d")) == ["one"]
    for name in ("", ".x", "a/b"):
        with pytest.raises(ValueError):
            commits.append_together(str(tmp_path), name, {"t": spark.range(1)})


@pytest.mark.parametrize("most", [10**6, 3])
def test_first_arrivals_are_sorted_once(spark, most):
    rows = [("w", f"a{i % 7 if i % 2 else 0}", i, f"id{i}") for i in range(60)] + [(None, None, i, f"n{i}") for i in (5, 3, 9)]
    df = spark.createDataFrame(rows[::-1], "ws string, asset_id string, arrival long, id string").repartition(3)
    out = I._first_per(df, ["ws", "asset_id"], "arrival", most=most)
    want = {}
    for ws, asset, arrival, ident in rows:
        want[ws, asset] = min(want.get((ws, asset), (arrival, ident)), (arrival, ident))
    assert {(r.ws, r.asset_id): (r.arrival, r.id) for r in out.collect()} == want
    # one sort, and the shuffle below it: nothing is sorted in the scan tasks
    plan = I._first_per(df, ["ws", "asset_id"], "arrival")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("Sort [") < plan.index("Exchange hashpartitioning")
