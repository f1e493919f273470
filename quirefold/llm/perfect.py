"""Minimal perfect hash of distinct keys, built in buckets and looked up in numpy.

A bucket is a cascade of bit fields. A key that alone falls on its place in the first field
sets that bit, the others go on to the next, smaller field. The slot of a key is the number
of bits before its own, so ``n`` keys use the slots ``0 .. n-1``; about three bits a key are
kept. A key that was not built in may get any slot or none: callers verify it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import Column

#: Keys of a bucket on average, and places of a field per key that it takes in.
BUCKET_KEYS, ROOM = 4096, 2
#: Keys are below this.
LIMIT = 1 << 31
_SPREAD = 2654435761


def bucket_of(key: Column, buckets: int) -> Column:
    return (key * _SPREAD % (1 << 32) / 16).cast("bigint") % buckets


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return keys * _SPREAD % (1 << 32) // 16 % buckets


def _place(keys: np.ndarray, field: int, size: np.ndarray | int) -> np.ndarray:
    salt = np.uint64((field + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    mixed = (keys.astype(np.uint64) + salt) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes of the fields of one bucket, and all their bits."""
    sizes, fields = [], []
    while len(keys):
        size = max(8, ROOM * len(keys))
        place = _place(keys, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        fields.append(alone)
        keys = keys[~alone[place]]
    return sizes, np.packbits(np.concatenate(fields)).tobytes() if fields else b""


class PerfectHash:
    """The fields of some of ``buckets`` buckets, given as ``(bucket, sizes, bits)``."""

    def __init__(self, parts: Sequence[tuple[int, Sequence[int], bytes]], buckets: int) -> None:
        self.parts, self.buckets = sorted((int(b), list(s), bytes(f)) for b, s, f in parts), buckets

    @cached_property
    def _fields(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Size and start of each field of each bucket; all bits; how many are set before each."""
        sizes = np.zeros((self.buckets, max((len(s) for _, s, _ in self.parts), default=0)), np.int64)
        bits = [np.zeros(0, bool)]
        for bucket, parts, packed in self.parts:
            sizes[bucket, : len(parts)] = parts
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(parts)).astype(bool))
        ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
        flat = np.concatenate(bits)
        return sizes, ends - sizes, flat, np.cumsum(flat, dtype=np.int32)

    def __len__(self) -> int:
        rank = self._fields[3]
        return int(rank[-1]) if len(rank) else 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        sizes, starts, bits, rank = self._fields
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        bucket = _bucket(keys, self.buckets)
        for field in range(sizes.shape[1]):
            left = left[sizes[bucket[left], field] > 0]
            if not len(left):
                break
            at = starts[bucket[left], field] + _place(keys[left], field, sizes[bucket[left], field])
            hit = bits[at]
            out[left[hit]] = rank[at[hit]] - 1
            left = left[~hit]
        return out
