"""Content identity: SHA-256 over a canonical JSON text (sorted keys, no spaces)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# The two-character escapes of JSON.
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_text(value: Column) -> Column:
    """A JSON string literal in ASCII: other characters as ``\\uXXXX``, pairs of them above U+FFFF."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        point = F.ascii(c).cast("bigint")
        out = F.when(point > 0xFFFF, F.concat(unit(F.lit(0xD800 - 0x40) + F.shiftright(point, 10)), unit(F.lit(0xDC00) + point.bitwiseAND(F.lit(0x3FF)))))
        for raw, short in SHORT_ESCAPES.items():
            out = out.when(c == raw, short)
        return out.when((point < 0x20) | (point > 0x7E), unit(point)).otherwise(c)

    points = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    plain = ~value.rlike(r'[^\x20-\x7E]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(F.array_join(F.transform(points, escaped), "")), F.lit('"'))


def json_object(fields: Mapping[str, Column]) -> Column:
    """An object with its keys sorted; values are already JSON text. NULL is ``null``."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def json_bool(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def label_map_text(labels: Column) -> Column:
    """A map of class id (as text) to label; keys sort as strings."""
    entries = F.array_sort(F.map_entries(labels))
    body = F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def label_map_hash(labels: Column) -> Column:
    return digest(label_map_text(labels))


PREPROCESS_TEXT = ("label_map_hash", "processor_class", "resize")
PREPROCESS_NUMBERS = ("render_dpi", "target", "tile_aspect", "tile_long_side_px", "tile_overlap")
RUNTIME_TEXT = ("graph_opt_level", "runtime")
RUNTIME_NUMBERS = ("batch_window_ms", "inter_op_threads", "intra_op_threads", "max_batch")


def _profile(prefix: str, text: Sequence[str], numbers: Sequence[str]) -> Column:
    return json_object({
        **{n: json_text(F.col(prefix + n)) for n in text},
        **{n: F.col(prefix + n).cast("string") for n in numbers},
    })


def preprocess_text(prefix: str = "") -> Column:
    return _profile(prefix, PREPROCESS_TEXT, PREPROCESS_NUMBERS)


def runtime_text(prefix: str = "") -> Column:
    return _profile(prefix, RUNTIME_TEXT, RUNTIME_NUMBERS)


def candidate_text(artifact_sha: Column, preprocess: Column, runtime: Column, threshold: Column, label_hash: Column, tiled: Column) -> Column:
    """Everything that defines a candidate; its name is left out."""
    return json_object({
        "artifact_sha": json_text(artifact_sha), "preprocess": preprocess, "runtime": runtime,
        "score_threshold": threshold.cast("string"), "label_map_hash": json_text(label_hash), "tile_enabled": json_bool(tiled)})


def host_fingerprint(*fields: str) -> Column:
    """First sixteen hex digits over the joined host facts; a missing fact is empty."""
    return F.substring(digest(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])), 1, 16)
