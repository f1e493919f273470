"""Media type and pixel size from the bytes of a container, without decoding it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Magic bytes (hex) in the order they are tested, then the RIFF form.
MAGIC = [
    ("89504E470D0A1A0A", "image/png"),
    ("255044462D", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
]
RIFF, WEBP = "52494646", "57454250"


def sniff_media(content: Column) -> Column:
    """A media type, ``empty`` or ``unrecognised``; what the client claimed plays no part."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
    for magic, name in MAGIC:
        kind = kind.when(head.startswith(magic), name)
    return kind.when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "image/webp").otherwise("unrecognised")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes at 0-based offset ``at``."""
    digits = F.hex(F.substring(content, at + 1, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def _pair(width: Column, height: Column) -> Column:
    return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


# Fixed values of the JPEG format: frame headers, markers without a body, markers that end the header.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset([0x01, *range(0xD0, 0xD9)])
ENDS = frozenset([0xD9, 0xDA])
_MARKER = re.compile(rb"\xff+([\x01-\xfe])")


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first frame header before the scan."""
    at = 2
    while marker := _MARKER.search(data, at):
        code, at = marker[1][0], marker.end()
        if code in ENDS:
            break
        if code in FRAMES:
            body = data[at + 3 : at + 7]
            return (int.from_bytes(body[2:], "big"), int.from_bytes(body[:2], "big")) if len(body) == 4 else None
        if code not in BARE:
            at += int.from_bytes(data[at : at + 2], "big")
    return None


@F.pandas_udf(_SIZE)
def _jpeg(content: pd.Series) -> pd.DataFrame:
    sizes = [_jpeg_size(bytes(raw)) or (None, None) if raw is not None else (None, None) for raw in content]
    return pd.DataFrame(sizes, columns=["width", "height"], dtype="Int64")


def _tiff_size(content: Column) -> Column:
    """ImageWidth (256) and ImageLength (257) among the entries of the first directory."""
    little = F.hex(F.substring(content, 1, 2)) == "4949"

    def number(at: Column, size: int) -> Column:
        digits = [F.hex(F.substring(content, (at + i + 1).cast("int"), F.lit(1))) for i in range(size)]
        return F.conv(F.when(little, F.concat(*reversed(digits))).otherwise(F.concat(*digits)), 16, 10).cast("bigint")

    def entry(n: Column, start: Column) -> Column:
        at = start + 2 + n * 12
        kind = number(at + 2, 2)
        value = F.when(kind == 3, number(at + 8, 2)).when(kind == 4, number(at + 8, 4))
        return F.struct(number(at, 2).alias("tag"), value.alias("value"))

    def directory(start: Column) -> Column:
        listed = F.least(number(start, 2), F.floor((F.length(content) - start - 2) / 12))
        return F.when((start + 2 <= F.length(content)) & (listed > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), listed - 1), lambda n: entry(n, start)))

    def sized(entries: Column) -> Column:
        first = lambda tag: F.try_element_at(F.filter(entries, lambda e: (e["tag"] == tag) & e["value"].isNotNull()), F.lit(1))["value"]
        return F.when(first(256).isNotNull() & first(257).isNotNull(), _pair(first(256), first(257)))

    # each step is bound to a lambda variable, so that it is worked out once
    entries = F.transform(F.array(number(F.lit(4), 4)), directory)
    return F.transform(entries, sized)[0]


def header_dims(content: Column) -> Column:
    """STRUCT<width, height>, or NULL when the header does not say or says zero.

    PNG, GIF and WebP are fixed offsets, TIFF entries are read by position; only JPEG, whose
    segments must be hopped over, is handed to Python, and only those bytes cross over.
    """
    head = F.hex(F.substring(content, 1, 32))
    size = F.length(content)
    webp = head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP)
    chunk = F.substring(head, 25, 8)
    bits = _number(content, 21, 4, True)
    low14 = F.lit(0x3FFF).cast("bigint")
    plus = lambda c: c + 1
    jpeg = head.startswith("FFD8")
    tiff = head.startswith("49492A00") | head.startswith("4D4D002A")
    dims = (
        F.when(head.startswith(MAGIC[0][0]) & (size >= 24) & (F.substring(head, 25, 8) == "49484452"), _pair(_number(content, 16, 4), _number(content, 20, 4)))
        .when((F.substring(head, 1, 12).isin("474946383761", "474946383961")) & (size >= 10), _pair(_number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when(webp & (size >= 30) & (chunk == "56503858"), _pair(plus(_number(content, 24, 3, True)), plus(_number(content, 27, 3, True))))
        .when(webp & (size >= 30) & (chunk == "56503820"), _pair(_number(content, 26, 2, True).bitwiseAND(low14), _number(content, 28, 2, True).bitwiseAND(low14)))
        .when(webp & (size >= 30) & (chunk == "5650384C"), _pair(plus(bits.bitwiseAND(low14)), plus(F.shiftright(bits, 14).bitwiseAND(low14))))
        .when(jpeg, _jpeg(F.when(jpeg, content)))
        .when(tiff, F.transform(F.array(content), _tiff_size)[0])
    )
    return F.when((dims["width"] > 0) & (dims["height"] > 0), dims)
