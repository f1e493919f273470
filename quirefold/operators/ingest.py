"""Ingest audit and registration.

Byte screens run in the scan stage and the content column is dropped there: bytes are
hashed and probed, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.media import header_dims, sniff_media
from quirefold.operators.ordering import HOT_ROWS

#: Buckets in which keys are counted to see whether one of them may be hot.
KEY_BUCKETS = 1 << 16


def encrypted_pdf(content: Column) -> Column:
    """``/Encrypt`` within the last 4096 bytes."""
    tail = F.when(F.length(content) > K.PDF_TAIL_BYTES, F.substring(content, -K.PDF_TAIL_BYTES, K.PDF_TAIL_BYTES)).otherwise(content)
    return F.instr(F.decode(tail, "ISO-8859-1"), "/Encrypt") > 0


def pixel_verdict(dims: Column, limit: int = K.MAX_PAGE_PIXELS) -> Column:
    """decode_failed, pixel_limit or ok, from the header alone; the product is 64-bit."""
    w, h = dims["width"].cast("bigint"), dims["height"].cast("bigint")
    return F.when(dims.isNull() | (w <= 0) | (h <= 0), "decode_failed").when(w * h > limit, "pixel_limit").otherwise("ok")


def asset_key(sha: Column) -> Column:
    return F.concat(F.lit("assets/"), sha)


def page_key(sha: Column) -> Column:
    return F.concat(F.lit("pages/"), sha, F.lit(".png"))


def screen_uploads(uploads: DataFrame, content: str = "content") -> DataFrame:
    """Every byte screen at once; the content column does not survive."""
    c = F.col(content)
    kept = [x for x in uploads.columns if x != content]
    out = uploads.select(
        *kept, F.length(c).cast("bigint").alias("byte_size"), F.sha2(c, 256).alias("sha256"), sniff_media(c).alias("media_type"),
        header_dims(c).alias("dims"), encrypted_pdf(c).alias("_encrypted"))
    failure = (
        F.when(F.col("media_type").isin("empty", "unrecognised"), "unsupported_type")
        .when((F.col("media_type") == "application/pdf") & F.col("_encrypted"), "encrypted_pdf")
        .when((F.col("media_type") != "application/pdf") & (pixel_verdict(F.col("dims")) != "ok"), pixel_verdict(F.col("dims"))))
    return out.withColumn("failure_code", failure).withColumn("object_key", asset_key(F.col("sha256"))).drop("_encrypted")


def failure_http_class(code: Column) -> Column:
    return F.when(code == "pixel_limit", 413).when(code == "unsupported_type", 415).when(code.isNotNull(), 422)


def unsafe_key(key: Column) -> Column:
    """Empty, absolute, or with a backslash, a double dot, or an empty or dot segment."""
    part = F.exists(F.split(key, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce((key == "") | key.startswith("/") | key.contains("..") | key.contains("\\") | part, F.lit(True))


def _first_per(df: DataFrame, keys: list[str], arrival: str, most: int = HOT_ROWS) -> DataFrame:
    """First arrival per key.

    Rows are sorted once, behind the shuffle. Reducing them before it would sort all of them
    in their scan tasks, on disk where they are many; only keys of crowded buckets are worth that.
    """
    rest = [c for c in df.columns if c not in keys and c != arrival]
    first = lambda rows: rows.groupBy(*keys).agg(F.min(F.struct(arrival, *rest)).alias("_f")).select(*keys, "_f.*")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    crowded = [r["_b"] for r in df.groupBy(bucket.alias("_b")).count().where(F.col("count") > most).select("_b").collect()]
    if not crowded:
        return first(df.repartition(*keys))
    hot = bucket.isin(crowded)
    return first(df.where(~hot).repartition(*keys)).unionByName(first(df.where(hot)))


def register_assets(uploads: DataFrame, existing: DataFrame, arrival: str = "arrival") -> DataFrame:
    """New asset rows: the first upload of each (ws, sha256) that is not stored yet."""
    return _first_per(uploads, ["ws", "sha256"], arrival).join(existing.select("ws", "sha256"), ["ws", "sha256"], "left_anti")


def resolve_assets(uploads: DataFrame, existing: DataFrame, registered: DataFrame) -> DataFrame:
    """The asset id each upload ends up with."""
    known = existing.select("ws", "sha256", F.col("id").alias("asset_id")).unionByName(registered.select("ws", "sha256", F.col("id").alias("asset_id")))
    return uploads.join(known, ["ws", "sha256"], "left")


def register_pages(pages: DataFrame, existing: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Insert-if-absent on (ws, asset, page_index); a stored render wins. ``fresh`` marks new rows."""
    key = ["ws", "asset_id", "page_index"]
    stored = existing.select(*key, F.col("id").alias("_id"), F.col("object_key").alias("_key"))
    first = _first_per(pages, key, arrival)
    return first.join(stored, key, "left").select(
        *key, F.coalesce("_id", "id").alias("id"), F.coalesce("_key", "object_key").alias("object_key"), F.col("_id").isNull().alias("fresh"))


def batch_limit_verdict(files: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """The first limit a batch breaks, in the order the checks are made.

    ``queue`` carries ``ws, queued``, the items that wait already. Files are taken in
    order: the first that breaks a rule stops the batch with its first broken rule.
    """
    fault = F.when(F.col("byte_size") > K.MAX_FILE_BYTES, "file_too_large").when(F.col("pages") > K.MAX_PAGES_PER_FILE, "file_has_too_many_pages")
    codes = ("file_too_large", "file_has_too_many_pages")
    # a smallest struct would sort every file in its scan task; numbers are kept in a hash table of batches
    firsts = [c for i, code in enumerate(codes) for c in (
        F.min(F.when(fault == code, F.col("file_no"))).alias(f"_first{i}"), F.count(F.when(fault == code, 1)).alias(f"_n{i}"),
        F.count(F.when((fault == code) & F.col("file_no").isNull(), 1)).alias(f"_blank{i}"))]
    totals = files.groupBy("ws", "batch_id").agg(
        F.count("*").alias("n_files"), F.sum("byte_size").alias("bytes"), F.sum("pages").alias("n_pages"), *firsts)
    # a file without a number comes first
    first = lambda i, code: F.when(F.col(f"_n{i}") > 0, F.struct(F.when(F.col(f"_blank{i}") == 0, F.col(f"_first{i}")).alias("file_no"), F.lit(code).alias("code")))
    totals = totals.withColumn("_fault", F.array_min(F.array(*[first(i, code) for i, code in enumerate(codes)]))).drop(*[f"{n}{i}" for n in ("_first", "_n", "_blank") for i in range(2)])
    totals = totals.withColumn("queued", F.lit(0)) if queue is None else totals.join(queue.select("ws", "queued"), "ws", "left")
    verdict = (
        F.when(F.col("n_files") > K.MAX_FILES_PER_BATCH, "too_many_files").when(F.col("bytes") > K.MAX_BATCH_BYTES, "batch_too_large")
        .when(F.coalesce("queued", F.lit(0)) >= K.MAX_QUEUE_DEPTH, "queue_full").when(F.col("_fault").isNotNull(), F.col("_fault.code"))
        .when(F.col("n_pages") > K.MAX_PAGES_PER_BATCH, "too_many_pages").otherwise("ok"))
    return totals.withColumn("verdict", verdict).drop("_fault")


def idempotent_batches(batches: DataFrame) -> DataFrame:
    """Each request with the batch it resolves to: the first with the same key, or itself."""
    keyed = batches.where(F.col("idempotency_key").isNotNull())
    first = keyed.groupBy("ws", "idempotency_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("batch_id"))
    # requests without a key would all meet in one partition of the join
    alone = batches.where(F.col("idempotency_key").isNull()).withColumn("batch_id", F.col("id"))
    return keyed.join(first, ["ws", "idempotency_key"]).unionByName(alone)


def fan_out_items(pages: DataFrame) -> DataFrame:
    """A primary item per page, and a shadow item where the batch names a shadow candidate."""
    item = lambda cand, pool, role: F.struct(F.col(cand).alias("candidate_id"), F.lit(pool).alias("pool"), F.lit(role).alias("role"))
    both = F.array(item("candidate_id", "torch", "primary"), item("shadow_candidate_id", "onnxruntime", "shadow"))
    wanted = F.filter(both, lambda i: i["candidate_id"].isNotNull())
    return pages.select("ws", "batch_id", "page_id", F.explode(wanted).alias("_i")).select("ws", "batch_id", "page_id", "_i.*")


def synthetic_flag(files: DataFrame) -> DataFrame:
    return files.groupBy("ws", "batch_id").agg(F.bool_and("synthetic").alias("synthetic"))


def upload_provenance(synthetic: Column, filename: Column) -> Column:
    return F.concat(F.when(synthetic, "synthetic-upload:").otherwise("upload:"), filename)


def stored_hashes(files: DataFrame) -> DataFrame:
    """``path, actual_sha`` of stored files (``path, content`` as binaryFile reads them); the bytes stay in the scan stage."""
    return files.select("path", F.sha2("content", 256).alias("actual_sha"))


def artifact_verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """missing, mismatch or ok per pinned artifact; ``actual`` carries ``ws, path, actual_sha``."""
    seen = actual.select("ws", "path", F.col("actual_sha").alias("_actual"))
    verdict = F.when(F.col("_actual").isNull(), "missing").when((F.col("sha256") != "") & (F.col("_actual") != F.col("sha256")), "mismatch").otherwise("ok")
    return expected.join(seen, ["ws", "path"], "left").withColumn("verdict", verdict).drop("_actual")
