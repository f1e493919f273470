"""Dataset, hashing and ground-truth queries, and the sinks."""

from __future__ import annotations

import uuid
from functools import reduce
from importlib import import_module

from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold import schemas as S
from quirefold.functions import hashing as H
from quirefold.functions.geometry import points_to_pixels as to_pixels
from quirefold.operators import benchstats as B
from quirefold.operators import datasets as D
from quirefold.plans.fixtures import oracle, table
from quirefold.session import scratch_root
from quirefold.sources import objects, readers, sinks


def _fresh(s, name):
    return f"{scratch_root(s)}/{name}-{uuid.uuid4().hex}"


# -- content identity --------------------------------------------------------------------------


def canonical_hash(s, d):
    fields = {"name": H.json_text(F.col("c_name")), "acctbal_cents": F.floor(F.col("c_acctbal") * 100).cast("string"), "segment": H.json_text(F.col("c_mktsegment")), "nation": F.col("c_nationkey").cast("string")}
    return table(s, d, "customer").select("c_custkey", H.digest(H.json_object(fields)).alias("hash"))


def document_hash(s, d):
    """Whole texts with quotes, backslashes and line breaks escaped."""
    body = H.json_object({"lang": H.json_text(F.col("lang")), "text": H.json_text(F.col("text"))})
    return table(s, d, "documents").select("doc_id", H.digest(body).alias("hash"))


def label_map_hash(s, d):
    m = F.create_map(F.lit("2"), F.col("p_name"), F.lit("0"), F.col("p_brand"), F.lit("10"), F.col("p_type"))
    return table(s, d, "part").select("p_partkey", H.label_map_hash(m).alias("hash"))


def _profiles(s, d):
    p = table(s, d, "part")
    return p.select(
        "p_partkey", F.col("p_brand").alias("label_map_hash"), F.lit("proc").alias("processor_class"), F.col("p_type").alias("resize"), F.lit(150).alias("render_dpi"),
        F.lit(640).alias("target"), F.lit(1.6).alias("tile_aspect"), F.lit(2200).alias("tile_long_side_px"), F.lit(0.15).alias("tile_overlap"),
        F.lit("all").alias("graph_opt_level"), F.when(F.col("p_partkey") % 2 == 0, "torch").otherwise("onnxruntime").alias("runtime"), F.lit(25).alias("batch_window_ms"),
        F.lit(1).alias("inter_op_threads"), F.col("p_size").alias("intra_op_threads"), F.lit(4).alias("max_batch"),
        (F.col("p_size").cast("double") / 100).alias("threshold"), F.sha2("p_name", 256).alias("sha"))


def profile_hash(s, d):
    return _profiles(s, d).select("p_partkey", H.digest(H.preprocess_text()).alias("preprocess_hash"), H.digest(H.runtime_text()).alias("runtime_hash"))


def candidate_hash(s, d):
    text = H.candidate_text(F.col("sha"), H.preprocess_text(), H.runtime_text(), F.col("threshold"), F.col("label_map_hash"), F.col("p_partkey") % 2 == 0)
    return _profiles(s, d).select("p_partkey", H.digest(text).alias("hash"))


def _page_hashes(s, d):
    return D.annotation_hash(table(s, d, "fx_truth_all"), ["ws", "dataset", "split", "page_id"], [F.col("box_id")])


def annotation_hash(s, d):
    return _page_hashes(s, d)


def manifest_hash(s, d):
    pages = _page_hashes(s, d).withColumn("page_sha", F.sha2(F.concat(F.lit("page"), "page_id"), 256))
    return D.manifest_hash(pages, ["ws", "dataset"], [F.col("page_id")])


def provenance_parts(s, d):
    doc = table(s, d, "documents")
    text = D.provenance_text(F.col("source"), F.lit("1"), F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "scan"))
    p = D.provenance_parts(text)
    return doc.select("doc_id", text.alias("provenance"), p["generator"].alias("generator"), p["seed"].alias("seed"), p["template"].alias("template"), F.coalesce(p["degrade"], F.lit("")).alias("degrade"))


# -- datasets ------------------------------------------------------------------------------------


def dataset_schedule(s, d):
    """A plan with one page per document of each source."""
    specs = table(s, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("total")).select(
        "name", "total", F.when(F.length("name") == 4, 9).otherwise(0).alias("calib"), (F.length("name") == 5).alias("bench"), (F.length("name") == 5).alias("two_up"))
    return D.dataset_schedule(specs)


def dataset_counts(s, d):
    return D.dataset_counts(table(s, d, "fx_truth_all"), ["ws", "dataset"])


def load_truth(s, d):
    return D.load_truth(table(s, d, "fx_annotation"), table(s, d, "fx_page"), table(s, d, "fx_dataset"), split="test").groupBy("ws", "dataset", "semver").agg(
        F.count("*").alias("boxes"), F.sum(F.col("width_px").cast("bigint")).alias("width_sum"))


def category_axis(s, d):
    labels = table(s, d, "part").groupBy(F.col("p_brand").alias("model"), (F.col("p_size") * 3).alias("class_id")).agg(F.min("p_type").alias("label"))
    return D.category_axis(labels, ["model"]).select("model", F.col("class_id").cast("bigint").alias("class_id"), "label")


def manifest_conflicts(s, d):
    return D.manifest_conflicts(table(s, d, "fx_dataset"))


def require_dataset(s, d):
    t = D.require_dataset(table(s, d, "fx_truth"), ["synth-clean", "synth-scan"])
    return t.groupBy("dataset").agg(F.count("*").alias("n"))


def gt_box_issues(s, d):
    return D.gt_box_issues(_misnamed(s, d), table(s, d, "fx_canvas")).groupBy("ws", "page_id", "rule").agg(F.sum("n").alias("n"))


def _misnamed(s, d):
    return table(s, d, "fx_truth_all").withColumn("class_id", F.when(F.col("box_id") % 31 == 0, 0).otherwise(F.col("class_id")))


def gt_report(s, d):
    boxes, pages = _misnamed(s, d), table(s, d, "fx_canvas")
    out = D.gt_report(boxes, pages, D.gt_box_issues(boxes, pages))
    errors = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("ws", "pages", "boxes", "n_errors", "ok", errors.alias("errors"))


def gt_ink_issues(s, d):
    """Whole documents laid out as small RGB rasters (a blank is white, so is the end of the last row); one box over the left half of each."""
    width = 40
    drawn = F.translate(F.replace("text", F.lit(" "), F.lit("ÿ" * 9)), "\n", " ")
    laid = table(s, d, "documents").select("doc_id", drawn.alias("t"), F.ceil(F.length(drawn) / (3 * width)).cast("int").alias("height")).where(F.col("height") > 0)
    pages = laid.select(
        F.concat(F.lit("w"), F.col("doc_id") % 4).alias("ws"), F.col("doc_id").alias("page_id"), F.lit(width).alias("width"), "height",
        F.encode(F.rpad("t", F.col("height") * (3 * width), F.lit("ÿ")), "ISO-8859-1").alias("rgb"))
    boxes = pages.select("ws", "page_id", F.lit(1).cast("bigint").alias("box_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(width / 2).alias("x2"), F.col("height").cast("double").alias("y2"))
    return D.gt_ink_issues(pages, boxes, margin=1).select("ws", "page_id", "rule", "box_id", F.round("share", 6).alias("share"))


def points_to_pixels(s, d):
    b = table(s, d, "fx_box")
    px = to_pixels(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(792.0), F.lit(150))
    return b.select("page_id", "box_id", *[c.alias(n) for c, n in zip(px, ("px1", "py1", "px2", "py2"))])


# -- sources and sinks ---------------------------------------------------------------------------


def object_listing(s, d):
    """Every document stored as an object of its own, then the store listed."""
    root = _fresh(s, "objects")
    prefix = F.lpad(F.hex(F.pmod("doc_id", F.lit(64))), 2, "0")
    key = F.concat(F.lit("assets/"), prefix, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    objects.write_objects(table(s, d, "documents").select(key.alias("key"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")), f"{root}/store")
    return objects.object_listing(s, f"{root}/store").select("key", "size")


def bench_samples(s, d):
    """Every trial written as JSON documents, then read back with the declared layout."""
    path = _fresh(s, "trials")
    sinks.write_trials(table(s, d, "fx_sample").withColumn("page_id", F.col("page").cast("string")).drop("page"), path)
    return readers.bench_samples(s, path, pretty=False).groupBy("config", "trial").agg(F.count("*").alias("n"), F.round(F.sum("service_ms"), 4).alias("service_ms"), F.max("peak_rss").alias("peak_rss"))


def load_tables(s, d):
    """All nineteen tables stored under their own column names and read back typed: rows, and filled required cells."""
    from quirefold.plans.q_ledger import AUDITED

    path, parts = _fresh(s, "ledger"), []
    for name, fx in AUDITED.items():
        sinks.write_table(table(s, d, fx), f"{path}/{name}", name)
        back = readers.load_table(s, path, name)
        parts.append(back.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count("id").alias("ids"), F.countDistinct("ws" if "ws" in back.columns else "id").alias("spaces")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def append_release_log(s, d):
    """Three appends, each asked for twice; the log and its audit trail grow together, once each."""
    path = _fresh(s, "log")
    r = table(s, d, "fx_release").withColumn("actor", F.lit("owner"))
    for action in ("seed", "promote", "rollback"):
        for _ in range(2):
            sinks.append_release_log(r.where(F.col("action") == action), path)
    log, audit = readers.release_log(s, path), readers.release_log(s, path, "audit_event")
    return log.join(audit.select("ws", F.col("after_hash").alias("id"), F.col("action").alias("event")), ["ws", "id"]).groupBy("ws", "event").agg(F.count("*").alias("n"))


def report_tables(s, d):
    """Eight sections as JSON documents, one row per report line."""
    from quirefold.plans import q_bench, q_detect, q_gates

    path = _fresh(s, "report")
    sinks.write_report({
        "env": q_bench.comparability(s, d), "throughput": q_bench.config_aggregate(s, d), "stability": q_bench.stability(s, d), "memory": q_bench.fit_memory(s, d),
        "quality": q_detect.quality_table(s, d), "gates": q_gates.gate_verdicts(s, d), "datasets": manifest_conflicts(s, d),
        "refusals": q_bench.runnable_verdict(s, d).where(F.col("verdict") != "ok")}, path)
    back = s.read.schema("section STRING, body STRING").json(path)
    return back.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.get_json_object("body", "$.passed") == "true", F.lit(False)).cast("bigint")).alias("passed"))


QUERIES = {f.__name__: f for f in (
    canonical_hash, document_hash, label_map_hash, profile_hash, candidate_hash, annotation_hash, manifest_hash, provenance_parts, dataset_schedule, dataset_counts, load_truth, category_axis,
    manifest_conflicts, require_dataset, gt_box_issues, gt_report, gt_ink_issues, points_to_pixels, object_listing, bench_samples, load_tables, append_release_log, report_tables)}

from quirefold.plans.q_detect import iou_sql  # noqa: E402
from quirefold.plans.q_gates import _V  # noqa: E402
from quirefold.plans.q_ledger import AUDITED  # noqa: E402

_PRE = """concat('{"label_map_hash":"', p_brand, '","processor_class":"proc","render_dpi":150,"resize":"', p_type, '","target":640,"tile_aspect":1.6,"tile_long_side_px":2200,"tile_overlap":0.15}')"""
_RUN = """concat('{"batch_window_ms":25,"graph_opt_level":"all","inter_op_threads":1,"intra_op_threads":', p_size, ',"max_batch":4,"runtime":"', CASE WHEN p_partkey % 2 = 0 THEN 'torch' ELSE 'onnxruntime' END, '"}')"""
# three levels of digests over runs of 4096: short lists are hashed three times
_AH = """bx AS (SELECT ws, dataset, split, page_id, box_id, sha256(concat_ws(',', printf('%.3f', x1), printf('%.3f', y1), printf('%.3f', x2), printf('%.3f', y2), class_id)) AS d, (row_number() OVER (PARTITION BY ws, dataset, split, page_id ORDER BY box_id) - 1) // 4096 AS c FROM fx_truth_all),
  l1 AS (SELECT ws, dataset, split, page_id, c, sha256(string_agg(d, ',' ORDER BY box_id)) AS d FROM bx GROUP BY ALL),
  l2 AS (SELECT ws, dataset, split, page_id, c // 4096 AS c, sha256(string_agg(d, ',' ORDER BY c)) AS d FROM l1 GROUP BY ws, dataset, split, page_id, l1.c // 4096),
  ah AS (SELECT ws, dataset, split, page_id, sha256(string_agg(d, ',' ORDER BY c)) AS annotation_hash FROM l2 GROUP BY ws, dataset, split, page_id)"""
_ISSUES = f"""tb AS (SELECT ws, page_id, box_id, label, CASE WHEN box_id % 31 = 0 THEN 0 ELSE class_id END AS class_id, x1, y1, x2, y2 FROM fx_truth_all),
  iss AS (SELECT ws, page_id, 'empty' AS rule FROM fx_canvas c WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.ws = c.ws AND tb.page_id = c.page_id)
    UNION ALL SELECT tb.ws, tb.page_id, 'out_of_bounds' FROM tb JOIN fx_canvas c ON c.ws = tb.ws AND c.page_id = tb.page_id WHERE NOT (0 <= x1 AND x1 < x2 AND x2 <= width AND 0 <= y1 AND y1 < y2 AND y2 <= height)
    UNION ALL SELECT ws, page_id, 'class_mismatch' FROM tb WHERE class_id <> CASE label WHEN 'table' THEN 8 WHEN 'picture' THEN 6 WHEN 'text' THEN 9 ELSE 10 END
    UNION ALL SELECT a.ws, a.page_id, 'same_class_overlap' FROM tb a JOIN tb b ON a.ws = b.ws AND a.page_id = b.page_id AND a.label = b.label AND a.box_id < b.box_id WHERE {iou_sql('a.', 'b.')} > 0.3::DOUBLE)"""
_Q = {
    "canonical_hash": """SELECT c_custkey, sha256(concat('{"acctbal_cents":', floor(c_acctbal * 100)::BIGINT, ',"name":"', c_name, '","nation":', c_nationkey, ',"segment":"', c_mktsegment, '"}')) AS hash FROM customer""",
    "document_hash": r"""WITH u AS (SELECT doc_id, lang, list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('"', '\') THEN '\' || c
          WHEN c = chr(8) THEN '\b' WHEN c = chr(9) THEN '\t' WHEN c = chr(10) THEN '\n' WHEN c = chr(12) THEN '\f' WHEN c = chr(13) THEN '\r'
          WHEN unicode(c) > 65535 THEN printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024)
          WHEN unicode(c) > 126 OR unicode(c) < 32 THEN printf('\u%04x', unicode(c)) ELSE c END) AS cs FROM documents)
        SELECT doc_id, sha256(concat('{"lang":"', lang, '","text":"', array_to_string(cs, ''), '"}')) AS hash FROM u""",
    "label_map_hash": """SELECT p_partkey, sha256(concat('{"0":"', p_brand, '","10":"', p_type, '","2":"', p_name, '"}')) AS hash FROM part""",
    "profile_hash": f"SELECT p_partkey, sha256({_PRE}) AS preprocess_hash, sha256({_RUN}) AS runtime_hash FROM part",
    "candidate_hash": f"""SELECT p_partkey, sha256(concat('{{"artifact_sha":"', sha256(p_name), '","label_map_hash":"', p_brand, '","preprocess":', {_PRE}, ',"runtime":', {_RUN}, ',"score_threshold":', p_size::DOUBLE / 100, ',"tile_enabled":', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, '}}')) AS hash FROM part""",
    "annotation_hash": f"WITH {_AH} SELECT * FROM ah",
    "manifest_hash": f"""WITH {_AH}, pg AS (SELECT ws, dataset, page_id, sha256(concat_ws('|', sha256(concat('page', page_id)), annotation_hash, split)) AS d, (row_number() OVER (PARTITION BY ws, dataset ORDER BY page_id) - 1) // 4096 AS c FROM ah),
        m1 AS (SELECT ws, dataset, c, sha256(string_agg(d, ',' ORDER BY page_id)) AS d FROM pg GROUP BY ws, dataset, c), m2 AS (SELECT ws, dataset, c // 4096 AS c, sha256(string_agg(d, ',' ORDER BY c)) AS d FROM m1 GROUP BY ws, dataset, m1.c // 4096)
        SELECT ws, dataset, sha256(string_agg(d, ',' ORDER BY c)) AS manifest_hash FROM m2 GROUP BY ws, dataset""",
    "provenance_parts": """SELECT doc_id, concat('synthetic:', source, '@1#seed=', doc_id, ',template=', lang, CASE WHEN doc_id % 2 = 0 THEN ',degrade=scan' ELSE '' END) AS provenance, source AS generator, doc_id AS seed, lang AS template, CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE '' END AS degrade FROM documents""",
    "dataset_schedule": """WITH sp AS (SELECT source AS name, count(*) AS total, length(source) = 5 AS b FROM documents GROUP BY source), pl AS (SELECT *, unnest(range(0, total)) AS i FROM sp)
        SELECT name, i AS page_index, CASE WHEN b AND i % 5 = 0 THEN 'two_up' ELSE (['single_column', 'two_column', 'slide', 'two_up'])[i % 4 + 1] END AS template, 1000000 + i AS seed,
          CASE WHEN NOT b AND length(name) = 4 AND i < least(9, total // 5) THEN 'calib' WHEN b THEN 'bench' ELSE 'test' END AS split FROM pl""",
    "dataset_counts": """SELECT ws, dataset, 'pages' AS axis, '' AS name, count(DISTINCT page_id) AS n FROM fx_truth_all GROUP BY ws, dataset UNION ALL SELECT ws, dataset, 'split', split, count(DISTINCT page_id) FROM fx_truth_all GROUP BY ws, dataset, split
        UNION ALL SELECT ws, dataset, 'class', label, count(*) FROM fx_truth_all GROUP BY ws, dataset, label""",
    "load_truth": "SELECT a.ws, d.name AS dataset, d.semver, count(*) AS boxes, sum(p.width_px)::BIGINT AS width_sum FROM fx_annotation a JOIN fx_page p ON p.ws = a.ws AND p.id = a.page_id JOIN fx_dataset d ON d.ws = a.ws AND d.id = a.dataset_version_id WHERE split = 'test' GROUP BY ALL",
    "category_axis": """WITH l AS (SELECT p_brand AS model, p_size * 3 AS class_id, min(p_type) AS label FROM part GROUP BY ALL), x AS (SELECT model, unnest(range(0, max(class_id)::BIGINT + 1)) AS class_id FROM l GROUP BY model)
        SELECT x.model, x.class_id, coalesce(l.label, concat('class_', x.class_id)) AS label FROM x LEFT JOIN l ON l.model = x.model AND l.class_id = x.class_id""",
    "manifest_conflicts": "SELECT ws, name, semver, count(DISTINCT manifest_hash) AS hashes, bool_and(synthetic) AS synthetic, count(DISTINCT manifest_hash) > 1 AS conflict FROM fx_dataset GROUP BY ws, name, semver",
    "require_dataset": "SELECT dataset, count(*) AS n FROM fx_truth GROUP BY dataset",
    "gt_box_issues": f"WITH {_ISSUES} SELECT ws, page_id, rule, count(*) AS n FROM iss GROUP BY ALL",
    "gt_report": f"""WITH {_ISSUES}, r AS (SELECT ws, rule, count(*) AS n FROM iss GROUP BY ALL), e AS (SELECT ws, sum(n)::BIGINT AS n_errors, string_agg(concat(rule, '=', n), ',' ORDER BY rule) AS errors FROM r GROUP BY ws)
        SELECT c.ws, (SELECT count(*) FROM fx_canvas p WHERE p.ws = c.ws) AS pages, (SELECT count(*) FROM tb WHERE tb.ws = c.ws) AS boxes, n_errors, n_errors = 0 AS ok, errors FROM (SELECT DISTINCT ws FROM fx_canvas) c JOIN e USING (ws)""",
    "points_to_pixels": "SELECT page_id, box_id, round(x1 * (150 / 72.0::DOUBLE), 2) AS px1, round((792 - y2) * (150 / 72.0::DOUBLE), 2) AS py1, round(x2 * (150 / 72.0::DOUBLE), 2) AS px2, round((792 - y1) * (150 / 72.0::DOUBLE), 2) AS py2 FROM fx_box",
    "bench_samples": """SELECT config, trial, count(*) AS n, round(sum(service_ms), 4) AS service_ms, max(peak_rss) AS peak_rss FROM fx_sample GROUP BY config, trial""",
    "load_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS rows, count(id) AS ids, count(DISTINCT {'id' if name == 'workspace' else 'ws'}) AS spaces FROM {fx}" for name, fx in AUDITED.items()),
    "gt_ink_issues": f"""WITH c AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM (SELECT doc_id, string_split(replace(replace(text, ' ', repeat('ÿ', 9)), chr(10), ' '), '') AS cs FROM documents WHERE text <> '') z),
        px AS (SELECT doc_id, i // 3 AS p, (sum(CASE WHEN unicode(c) > 255 THEN 63 ELSE unicode(c) END) + 255 * (3 - count(*))) / 3.0 < {K.INK_LEVEL}::DOUBLE AS ink FROM c GROUP BY doc_id, i // 3),
        xy AS (SELECT doc_id, p % 40 AS x, p // 40 AS y, ink, max(p // 40) OVER (PARTITION BY doc_id) + 1 AS h FROM px),
        pg AS (SELECT doc_id, count(*) FILTER (ink AND x < 20)::DOUBLE / (20 * max(h)) AS share, count(*) FILTER (ink AND x BETWEEN 1 AND 38 AND y BETWEEN 1 AND h - 2) AS total,
               count(*) FILTER (ink AND x BETWEEN 1 AND 19 AND y BETWEEN 1 AND h - 2) AS inside FROM xy GROUP BY doc_id)
        SELECT concat('w', doc_id % 4) AS ws, doc_id AS page_id, 'no_ink' AS rule, 1::BIGINT AS box_id, round(share, 6) AS share FROM pg WHERE share < {K.MIN_INK_FRACTION}::DOUBLE
        UNION ALL SELECT concat('w', doc_id % 4), doc_id, 'ink_uncovered', -1, round(inside::DOUBLE / total, 6) FROM pg WHERE total > 0 AND inside::DOUBLE / total < {K.MIN_INK_COVERAGE}::DOUBLE""",
    "object_listing": "SELECT concat('assets/', lpad(printf('%X', doc_id % 64), 2, '0'), '/', doc_id, '.txt') AS key, octet_length(encode(coalesce(text, ''))) AS size FROM documents",
    "append_release_log": "SELECT ws, concat('release.', action) AS event, count(*) AS n FROM fx_release GROUP BY ws, action",
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}


def _report_sql() -> str:
    bench, detect, gates = (import_module(f"quirefold.plans.{m}").ORACLES for m in ("q_bench", "q_detect", "q_gates"))
    sections = {
        "env": bench["comparability"], "throughput": bench["config_aggregate"], "stability": bench["stability"], "memory": bench["fit_memory"], "quality": detect["quality_table"],
        "gates": gates["gate_verdicts"], "datasets": ORACLES["manifest_conflicts"], "refusals": f"SELECT * FROM ({bench['runnable_verdict']}) r WHERE verdict <> 'ok'"}
    return " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS n, {'count(*) FILTER (passed)' if n == 'gates' else '0'} AS passed FROM ({q}) q" for n, q in sections.items())


ORACLES["report_tables"] = _report_sql()
