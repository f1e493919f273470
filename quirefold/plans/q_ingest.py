"""Ingest audit and registration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions.media import header_dims as dims_of
from quirefold.functions.media import sniff_media as media_of
from quirefold.operators import ingest as I
from quirefold.plans.fixtures import oracle, table

_CASES = 10


def _be(c, digits):
    return F.lpad(F.hex(c), digits, "0")


def _le(c, size):
    h = _be(c, size * 2)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def _uploads(s, d):
    """Each page's bytes behind a real container header whose size follows from the page id."""
    p = table(s, d, "pages")
    n = F.col("page_id")
    w, h = 100 + n * 137 % 9000, 50 + n * 291 % 9000
    hexed = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(w, 8), _be(h, 8)),
        F.concat(F.lit("474946383961"), _le(w, 2), _le(h, 2)),
        F.concat(F.lit("524946460000000057454250565038580A00000000000000"), _le(w - 1, 3), _le(h - 1, 3)),
        F.concat(F.lit("524946460000000057454250565038200A000000" "1000009D012A"), _le(w, 2), _le(h, 2)),
        F.concat(F.lit("5249464600000000574542505650384C0A0000002F"), _le((w - 1) + (h - 1) * 16384, 4)),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), _be(h, 4), _be(w, 4)),
        F.concat(F.lit("49492A00080000000200" "0001030001000000"), _le(w, 2), F.lit("0000" "0101030001000000"), _le(h, 2), F.lit("0000")),
        F.concat(F.lit("4D4D002A000000080002" "0100000400000001"), _be(w, 8), F.lit("0101000400000001"), _be(h, 8)),
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(w * 0, 8), _be(h, 8)),
        F.lit(""),
    ]
    head = F.lit(None).cast("string")
    for i, text in enumerate(hexed):
        head = F.when(n % _CASES == i, text).otherwise(head)
    return p.select("page_id", "url", F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"))


def sniff_media(s, d):
    return _uploads(s, d).select("page_id", media_of(F.col("content")).alias("media_type"))


def header_dims(s, d):
    out = _uploads(s, d).select("page_id", dims_of(F.col("content")).alias("z"))
    return out.select("page_id", F.coalesce("z.width", F.lit(-1)).alias("width"), F.coalesce("z.height", F.lit(-1)).alias("height"))


def pixel_limit_screen(s, d):
    return _uploads(s, d).select("page_id", I.pixel_verdict(dims_of(F.col("content"))).alias("verdict"))


def pdf_encryption_screen(s, d):
    p = table(s, d, "pages")
    mark = F.lit("/Encrypt 5 0 R")
    body = F.when(F.col("page_id") % 4 == 0, F.concat("html", mark)).when(F.col("page_id") % 4 == 1, F.concat(mark, "html")).otherwise(F.col("html"))
    return p.select("page_id", I.encrypted_pdf(F.encode(body, "UTF-8")).alias("encrypted"))


def screen_uploads(s, d):
    return I.screen_uploads(_uploads(s, d)).select("page_id", "byte_size", "sha256", "media_type", "object_key", F.coalesce("failure_code", F.lit("")).alias("failure_code"))


def content_key(s, d):
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    return table(s, d, "documents").select("doc_id", sha.alias("sha256"), I.asset_key(sha).alias("asset_key"), I.page_key(sha).alias("page_key"))


def _content(s, d):
    return table(s, d, "fx_content").select("ws", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("arrival"), F.concat(F.lit("as"), "doc_id").alias("id"))


def _stored(s, d):
    good = table(s, d, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("arrival"))
    return _content(s, d).join(good, "arrival", "left_semi").select("ws", "sha256", F.concat(F.lit("old"), "id").alias("id")).groupBy("ws", "sha256").agg(F.min("id").alias("id"))


def register_assets(s, d):
    return I.register_assets(_content(s, d), _stored(s, d)).select("ws", "sha256", "id")


def resolve_assets(s, d):
    up, old = _content(s, d), _stored(s, d)
    return I.resolve_assets(up, old, I.register_assets(up, old)).select("id", "asset_id")


def register_pages(s, d):
    """Every page delivered twice, the second time with another render; 300-dpi ones are stored already."""
    p = table(s, d, "fx_page")
    twice = p.select("ws", "asset_id", "page_index", "id", "object_key", F.lit(1).alias("arrival")).unionByName(
        p.select("ws", "asset_id", "page_index", F.concat("id", F.lit("b")).alias("id"), F.concat("object_key", F.lit("b")).alias("object_key"), F.lit(2).alias("arrival")))
    stored = p.where(F.col("render_dpi") == 300).select("ws", "asset_id", "page_index", F.concat(F.lit("s"), "id").alias("id"), "object_key")
    return I.register_pages(twice, stored).select("ws", "asset_id", F.col("page_index").cast("bigint").alias("page_index"), "id", "object_key", "fresh")


def batch_limit_verdict(s, d):
    """The queue of a workspace is taken modulo a thousand, so that some are full and some are not."""
    queue = table(s, d, "fx_item").where(F.col("state") == "queued").groupBy("ws").agg((F.count("*") % 1000).alias("queued"))
    return I.batch_limit_verdict(table(s, d, "fx_upload"), queue).select("ws", "batch_id", "n_files", "bytes", "n_pages", "verdict")


def failure_http_class(s, d):
    i = table(s, d, "fx_item").where(F.col("failure_code").isNotNull())
    return i.groupBy("failure_code").agg(F.count("*").alias("n")).select("failure_code", "n", I.failure_http_class(F.col("failure_code")).cast("bigint").alias("status"))


def idempotent_batches(s, d):
    return I.idempotent_batches(table(s, d, "fx_batch")).select("ws", "id", "batch_id")


def _to_fan_out(s, d):
    b = table(s, d, "fx_batch").select("ws", F.col("id").alias("batch_id"), "release_id", "shadow_candidate_id", F.concat(F.lit("as"), F.expr("substring(id, 2)")).alias("asset_id"))
    r = table(s, d, "fx_release").select("ws", F.col("id").alias("release_id"), "candidate_id")
    p = table(s, d, "fx_page").select("ws", "asset_id", F.col("id").alias("page_id"))
    return p.join(b, ["ws", "asset_id"]).join(r, ["ws", "release_id"])


def fan_out_items(s, d):
    return I.fan_out_items(_to_fan_out(s, d))


def synthetic_flag(s, d):
    return I.synthetic_flag(table(s, d, "fx_upload"))


def upload_provenance(s, d):
    return table(s, d, "fx_upload").select("batch_id", F.col("file_no").cast("bigint").alias("file_no"), I.upload_provenance(F.col("synthetic"), F.col("filename")).alias("provenance"))


def unsafe_keys(s, d):
    """Keys made of every page address, some damaged in each way a key can be unsafe."""
    bare = F.regexp_replace("url", "^https?://", "")
    n = F.col("page_id") % 7
    key = (F.when(n == 0, F.concat(F.lit("/"), bare)).when(n == 1, F.concat(bare, F.lit("/../x"))).when(n == 2, F.concat(bare, F.lit("\\x")))
           .when(n == 3, F.concat(bare, F.lit("//x"))).when(n == 4, F.concat(bare, F.lit("/./x"))).otherwise(bare))
    return table(s, d, "pages").select("page_id", key.alias("key")).where(I.unsafe_key(F.col("key"))).select("page_id", "key")


QUERIES = {f.__name__: f for f in (
    sniff_media, header_dims, pixel_limit_screen, pdf_encryption_screen, screen_uploads, content_key, register_assets, resolve_assets, register_pages, batch_limit_verdict,
    failure_http_class, idempotent_batches, fan_out_items, synthetic_flag, upload_provenance, unsafe_keys)}

_DIM = """dm AS (SELECT *, page_id % 10 < 8 AS known, 100 + page_id * 137 % 9000 AS w, 50 + page_id * 291 % 9000 AS h FROM pages)"""
_LE = lambda v, n: " || ".join(f"substring(lpad(printf('%X', {v}), {n * 2}, '0'), {2 * i + 1}, 2)" for i in reversed(range(n)))
_BE = lambda v, n: f"lpad(printf('%X', {v}), {n}, '0')"
_HEX = f"""CASE page_id % 10 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || {_BE('w', 8)} || {_BE('h', 8)} WHEN 1 THEN '474946383961' || {_LE('w', 2)} || {_LE('h', 2)}
  WHEN 2 THEN '524946460000000057454250565038580A00000000000000' || {_LE('(w - 1)', 3)} || {_LE('(h - 1)', 3)} WHEN 3 THEN '524946460000000057454250565038200A0000001000009D012A' || {_LE('w', 2)} || {_LE('h', 2)}
  WHEN 4 THEN '5249464600000000574542505650384C0A0000002F' || {_LE('((w - 1) + (h - 1) * 16384)', 4)} WHEN 5 THEN 'FFD8FFE000104A46494600010100000100010000FFC0001108' || {_BE('h', 4)} || {_BE('w', 4)}
  WHEN 6 THEN '49492A000800000002000001030001000000' || {_LE('w', 2)} || '00000101030001000000' || {_LE('h', 2)} || '0000' WHEN 7 THEN '4D4D002A0000000800020100000400000001' || {_BE('w', 8)} || '0101000400000001' || {_BE('h', 8)}
  WHEN 8 THEN '89504E470D0A1A0A0000000D4948445200000000' || {_BE('h', 8)} ELSE '' END"""
_STORED = """c AS (SELECT ws, @sha(text) AS sha256, doc_id, concat('as', doc_id) AS id FROM fx_content),
  old AS (SELECT ws, sha256, min(concat('old', id)) AS id FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ws, sha256),
  fresh AS (SELECT ws, sha256, arg_min(id, doc_id) AS id FROM c WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.ws = c.ws AND old.sha256 = c.sha256) GROUP BY ws, sha256)"""
_Q = {
    "sniff_media": f"""WITH {_DIM}, h AS (SELECT page_id, left({_HEX}, 32) || left(hex(encode(html)), 32) AS head_hex FROM dm)
        SELECT page_id, CASE WHEN head_hex = '' THEN 'empty' WHEN starts_with(head_hex, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(head_hex, '255044462D') THEN 'application/pdf'
        WHEN starts_with(head_hex, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(head_hex, '49492A00') OR starts_with(head_hex, '4D4D002A') THEN 'image/tiff'
        WHEN starts_with(head_hex, '52494646') AND substring(head_hex, 17, 8) = '57454250' THEN 'image/webp' ELSE 'unrecognised' END AS media_type FROM h""",
    "header_dims": f"WITH {_DIM} SELECT page_id, CASE WHEN known THEN w ELSE -1 END AS width, CASE WHEN known THEN h ELSE -1 END AS height FROM dm",
    "pixel_limit_screen": f"WITH {_DIM} SELECT page_id, CASE WHEN NOT known THEN 'decode_failed' WHEN w * h > 40000000 THEN 'pixel_limit' ELSE 'ok' END AS verdict FROM dm",
    "pdf_encryption_screen": """SELECT page_id, contains(right(hex(encode(CASE page_id % 4 WHEN 0 THEN html || '/Encrypt 5 0 R' WHEN 1 THEN '/Encrypt 5 0 R' || html ELSE html END)), 8192), '2F456E6372797074') AS encrypted FROM pages""",
    "screen_uploads": f"""WITH {_DIM}, u AS (SELECT page_id, known, w, h, unhex({_HEX}) || encode(html) AS content FROM dm)
        SELECT page_id, octet_length(content) AS byte_size, sha256(content) AS sha256, CASE page_id % 10 WHEN 0 THEN 'image/png' WHEN 8 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/jpeg' WHEN 6 THEN 'image/tiff' WHEN 7 THEN 'image/tiff' ELSE 'unrecognised' END AS media_type,
          concat('assets/', sha256(content)) AS object_key, CASE WHEN page_id % 10 IN (1, 9) THEN 'unsupported_type' WHEN NOT known THEN 'decode_failed' WHEN w * h > 40000000 THEN 'pixel_limit' ELSE '' END AS failure_code FROM u""",
    "content_key": "SELECT doc_id, sha256(text) AS sha256, concat('assets/', sha256(text)) AS asset_key, concat('pages/', sha256(text), '.png') AS page_key FROM documents",
    "register_assets": f"WITH {_STORED} SELECT ws, sha256, id FROM fresh",
    "resolve_assets": f"WITH {_STORED} SELECT c.id, coalesce(old.id, fresh.id) AS asset_id FROM c LEFT JOIN old ON old.ws = c.ws AND old.sha256 = c.sha256 LEFT JOIN fresh ON fresh.ws = c.ws AND fresh.sha256 = c.sha256",
    "register_pages": "SELECT ws, asset_id, page_index::BIGINT AS page_index, CASE WHEN render_dpi = 300 THEN concat('s', id) ELSE id END AS id, object_key, render_dpi <> 300 AS fresh FROM fx_page",
    "batch_limit_verdict": """WITH q AS (SELECT ws, count(*) % 1000 AS queued FROM fx_item WHERE state = 'queued' GROUP BY ws),
        f AS (SELECT *, CASE WHEN byte_size > 26214400 THEN 'file_too_large' WHEN pages > 30 THEN 'file_has_too_many_pages' END AS fault FROM fx_upload)
        SELECT ws, batch_id, count(*) AS n_files, sum(byte_size)::BIGINT AS bytes, sum(pages)::BIGINT AS n_pages, CASE WHEN count(*) > 50 THEN 'too_many_files' WHEN sum(byte_size) > 104857600 THEN 'batch_too_large'
        WHEN coalesce(any_value(queued), 0) >= 500 THEN 'queue_full' WHEN count(fault) > 0 THEN arg_min(fault, file_no) FILTER (fault IS NOT NULL) WHEN sum(pages) > 200 THEN 'too_many_pages' ELSE 'ok' END AS verdict
        FROM f LEFT JOIN q USING (ws) GROUP BY ws, batch_id""",
    "failure_http_class": "SELECT failure_code, count(*) AS n, CASE failure_code WHEN 'pixel_limit' THEN 413 WHEN 'unsupported_type' THEN 415 ELSE 422 END::BIGINT AS status FROM fx_item WHERE failure_code IS NOT NULL GROUP BY failure_code",
    "idempotent_batches": "SELECT ws, id, CASE WHEN idempotency_key IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY ws, idempotency_key ORDER BY created_at, id) END AS batch_id FROM fx_batch",
    "fan_out_items": """WITH f AS (SELECT p.ws, b.id AS batch_id, p.id AS page_id, r.candidate_id, b.shadow_candidate_id FROM fx_page p JOIN fx_batch b ON b.ws = p.ws AND concat('as', substring(b.id, 2)) = p.asset_id JOIN fx_release r ON r.ws = b.ws AND r.id = b.release_id)
        SELECT ws, batch_id, page_id, candidate_id, 'torch' AS pool, 'primary' AS role FROM f UNION ALL SELECT ws, batch_id, page_id, shadow_candidate_id, 'onnxruntime', 'shadow' FROM f WHERE shadow_candidate_id IS NOT NULL""",
    "synthetic_flag": "SELECT ws, batch_id, bool_and(synthetic) AS synthetic FROM fx_upload GROUP BY ws, batch_id",
    "upload_provenance": "SELECT batch_id, file_no::BIGINT AS file_no, concat(CASE WHEN synthetic THEN 'synthetic-upload:' ELSE 'upload:' END, filename) AS provenance FROM fx_upload",
    "unsafe_keys": r"""WITH k AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('/', b) WHEN 1 THEN concat(b, '/../x') WHEN 2 THEN concat(b, '\x') WHEN 3 THEN concat(b, '//x') WHEN 4 THEN concat(b, '/./x') ELSE b END AS key
        FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS b FROM pages) z) SELECT page_id, key FROM k
        WHERE key = '' OR starts_with(key, '/') OR contains(key, '..') OR contains(key, '\') OR len(list_filter(string_split(key, '/'), lambda p: p IN ('', '.', '..'))) > 0""",
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}
