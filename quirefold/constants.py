"""Limits, enumerations and thresholds the operators must agree on."""

# Layout classes in the model's index order.
CLASS_NAMES = [
    "caption", "footnote", "formula", "list_item", "page_footer", "page_header",
    "picture", "section_header", "table", "text", "title", "document_index", "code",
    "checkbox_selected", "checkbox_unselected", "form", "key_value_region",
]
CRITICAL_CLASSES = ["table", "picture", "text", "title"]

# Enumerations.
POOLS = ["torch", "onnxruntime"]
ITEM_STATES = ["queued", "running", "succeeded", "failed", "cancelled"]
BATCH_STATES = ["queued", "running", "succeeded", "failed", "cancelled", "partial"]
ITEM_ROLES = ["primary", "shadow"]
WORKSPACE_KINDS = ["local", "sandbox"]
TOKEN_ROLES = ["viewer", "operator", "owner"]
ARTIFACT_FORMATS = ["safetensors", "onnx-fp32", "onnx-int8"]
SPLITS = ["calib", "test", "bench"]
ANNOTATION_SOURCES = ["generator", "human"]
RELEASE_ACTIONS = ["promote", "rollback", "seed"]
RUN_STATES = ["pending", "running", "done", "failed"]
FAILURE_CODES = [
    "decode_failed", "pixel_limit", "unsupported_type", "encrypted_pdf", "zero_page_pdf",
    "render_failed", "exceeds_memory_budget", "artifact_corrupt", "load_failed",
    "inference_failed", "cancelled", "max_attempts", "storage_unavailable", "lease_lost",
]

# Ingest limits.
MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_BATCH_BYTES = 100 * 1024 * 1024
MAX_FILES_PER_BATCH = 50
MAX_PAGES_PER_FILE = 30
MAX_PAGES_PER_BATCH = 200
MAX_PAGE_PIXELS = 40_000_000
MAX_QUEUE_DEPTH = 500
PDF_TAIL_BYTES = 4096

# Ledger policy.
LEASE_SECONDS = 60
MAX_ATTEMPTS = 3
CLAIM_BATCH = 8
MAX_BATCH = 4
BATCH_WINDOW_MS = 25
ORPHAN_GRACE_HOURS = 24
SANDBOX_QUOTA = 200

# Memory policy.
WORKER_MEM_BUDGET = 4 * 1024 * 1024 * 1024
SAFETY_MARGIN = 0.15
HOST_MEM_FRACTION = 0.5
HARD_CAP_FRACTION = 0.85
MISPREDICTION_FACTOR = 1.10

# Detection and evaluation.
SCORE_THRESHOLD = 0.30
SCORE_FLOOR = 0.05
NMS_IOU = 0.6
MATCH_IOU = 0.5
AGREEMENT_IOU = 0.9
TILE_LONG_SIDE = 2200
TILE_ASPECT = 1.6
TILE_OVERLAP = 0.15
MAX_DETS = 100
COCO_EPS = 2.220446049250313e-16
COCO_IOU_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]
F1_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60]
LOGIT_RELATIVE_BOUND = 5e-3

# Ground-truth validation.
MIN_INK_FRACTION = 0.02
MIN_INK_COVERAGE = 0.995
MAX_SAME_CLASS_IOU = 0.3
INK_MARGIN_PX = 60
INK_LEVEL = 240.0

# Release gates.
GATE_CLEAN_DROP = 0.010
GATE_SHIFT_DROP = 0.020
GATE_CLASS_DROP = 0.030
GATE_AGREEMENT = 0.98

# Benchmark protocol.
WARMUP_PAGES = 20
MEASURED_PAGES = 200
CV_TOLERANCE = 0.05
DRIFT_TOLERANCE = 0.10
MIN_FREE_FRACTION = 0.25
BOOTSTRAP_RESAMPLES = 10_000
BOOTSTRAP_SEED = 20261005
ENV_FIELDS = [
    "cpu_brand", "cpu_physical_cores", "cpu_perf_levels", "mem_total_bytes", "os_version", "machine",
]

# Dataset schedule.
TEMPLATES = ["single_column", "two_column", "slide", "two_up"]
PAGE_SEED_BASE = 1_000_000
