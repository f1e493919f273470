"""Adaptive context-mixing range coder for token ids, in blocks that stand alone.

A block of up to ``BLOCK`` ids starts with empty tables and ends with a checksum, so any
block can be read without its neighbours and damage stays within one. Up to ``LANES``
blocks of a call are coded in lockstep, one numpy lane each.

For every id three predictions are made: the id last confirmed after the two ids before
(order 2), after the one before (order 1), and the block's current majority id (order 0).
One coding step says which of them is right, or that none is; its distribution is the mix
of two adaptive models, one that sees how sure order 2 is and whether order 1 agrees, one
that sees how sure order 1 is and what the last step was. An id that nobody predicted
is kept beside the coder's digits, in 16 bits.

The coder keeps a 32-bit range and writes 16-bit digits; carries are added to digits
already written and settled once at the end.

File form of a run of blocks, little-endian: ``QFCM``, version, number of blocks; per block
the number of ids, of digits and of ids that nobody predicted, and the crc32 of its ids as
16-bit numbers; then the digits of all blocks, then their unpredicted ids. Ids are below
65536.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quirefold.llm.common import offsets

BLOCK = 2048
#: Blocks in lockstep; a step costs some 0.2 ms on top of what its lanes cost.
LANES = 4096
MAGIC, VERSION = b"QFCM", 2
_HEAD = struct.Struct("<4sII")
_BITS2, _BITS1 = 9, 8
_U = np.uint64


def _packed(*fields: int) -> np.uint64:
    return _U(sum(f << 16 * i for i, f in enumerate(fields)))


#: Four events in one 64-bit word of four fields: where each event's share ends, out of 4096.
_START = _packed(1024, 1536, 1792, 4096)
_FIFTH, _SIXTH = _packed(*[0x07FF] * 4), _packed(*[0x03FF] * 4)
#: What each event adds: 128 to the end of its share and of those above it.
_PULL = np.array([_packed(*(128 * (i >= event) for i in range(4))) for event in range(4)])
#: Two models are added, so shares are out of 8192; every event keeps at least 32 of them.
_TOTAL, _LEAST = 13, _packed(32, 64, 96, 128)


class Damaged(ValueError):
    """A block does not match its checksum, or the bytes are no run of blocks."""


class _Model:
    """Tables of all lanes; ``predict`` before an id is known, ``learn`` after. Rows of the arrays: order 2, order 1."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.lane, self.lanes = lane, lanes
        self.base, self.base_seen = np.stack([lane << _BITS2, (lanes << _BITS2) + (lane << _BITS1)]), np.stack([lane * 8, lanes * 8 + lane * 16])
        self.table, self.models = np.zeros((lanes << _BITS2) + (lanes << _BITS1), np.int32), np.full(lanes * 24, _START)
        self.at, self.at_seen = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int64)
        self.entry, self.seen = np.empty((2, lanes), np.int32), np.empty((2, lanes), np.uint64)
        #: what each event says the id is: order 2, order 1, majority, and room for the id nobody predicted
        self.says = np.zeros((4, lanes), np.int32)
        self.known, self.majority = self.says[:2], self.says[2]
        self.votes, self.event = np.zeros(lanes, np.int32), np.zeros(lanes, np.uint8)
        self.hash, self.last = np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32)
        self.shares = np.zeros((5, lanes), np.uint32)

    def predict(self) -> None:
        """Look up what the two tables and models hold for the contexts of all lanes."""
        context = self.hash
        np.multiply(self.last, np.uint32(60493), out=context[0])
        context[0] += context[1]
        np.multiply(self.last, np.uint32(40503), out=context[1])
        slot = context >> np.uint32(5)
        slot[0] &= np.uint32((1 << _BITS2) - 1)
        slot[1] &= np.uint32((1 << _BITS1) - 1)
        np.add(slot, self.base, out=self.at)
        self.table.take(self.at, out=self.entry, mode="clip")
        np.bitwise_and(self.entry, 0xFFFF, out=self.known)
        sure = self.entry >> 16
        sure[0] += sure[0]
        sure[0] += self.known[0] == self.known[1]
        sure[1] <<= 2
        sure[1] += self.event
        np.add(sure, self.base_seen, out=self.at_seen)
        self.models.take(self.at_seen, out=self.seen, mode="clip")

    def shared(self, width: np.ndarray) -> np.ndarray:
        """Where the share of each event starts and the last one ends, when ``width`` is dealt out by the mix."""
        mix = self.seen[0] + self.seen[1]
        part = (mix >> _U(6)) & _SIXTH
        mix -= part
        mix += _LEAST
        np.multiply(mix.view("<u2").reshape(-1, 4).T, width >> np.uint32(_TOTAL), out=self.shares[1:], dtype=np.uint32, casting="unsafe")
        return self.shares

    def event_of(self, ids: np.ndarray) -> np.ndarray:
        """The first that says the id, 3 where none does."""
        wrong = (self.says[:3] != ids).view(np.uint8)
        event = wrong[2]
        for other in (wrong[1], wrong[0]):
            event = (event + np.uint8(1)) * other
        return event

    def learn(self, event: np.ndarray, ids: np.ndarray) -> None:
        """Tables: confirmed is one surer, up to 3; wrong is one less sure, and replaced when it was not sure at all."""
        right = self.says[:3] == ids
        seen, entry = self.seen, self.entry
        fall = seen >> _U(5)
        fall &= _FIFTH
        seen -= fall
        seen += _PULL.take(event, mode="clip")
        self.models[self.at_seen] = seen
        step = right.astype(np.int32)
        step <<= 1
        step -= 1
        self.votes += step[2]
        step = step[:2]
        step <<= 16
        entry += step
        np.minimum(entry, self.known | 0x30000, out=entry)
        np.copyto(entry, ids, where=entry < 0)
        self.table[self.at] = entry
        np.copyto(self.majority, ids, where=self.votes < 0)
        np.maximum(self.votes, 0, out=self.votes)
        self.last, self.event = ids.astype(np.uint32), event


def _coded(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ids with a column for each lane: digits with a row for each lane, their number, and which ids nobody predicted."""
    block, lanes = steps.shape
    model = _Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFF, np.uint32)
    digits, at = np.zeros((lanes, block + 4), np.uint32), np.zeros(lanes, np.int64)
    alone = np.empty((block, lanes), bool)

    def put(some: np.ndarray) -> None:
        value = low[some]
        digits[some, at[some]] = value >> _U(16)
        at[some] += 1
        low[some] = (value & _U(0xFFFF)) << _U(16)

    for step, now in enumerate(steps):
        model.predict()
        event = model.event_of(now)
        shares = model.shared(width)
        place = event * np.int64(lanes)
        place += model.lane
        start = shares.take(place, mode="clip")
        place += lanes
        np.subtract(shares.take(place, mode="clip"), start, out=width)
        low += start
        some = np.flatnonzero(width < 65536)
        put(some)
        width[some] <<= np.uint32(16)
        np.equal(event, 3, out=alone[step])
        model.learn(event, now)
    every = np.arange(lanes)
    put(every)
    put(every)
    for i in range(int(at.max()) - 1, 0, -1):
        digits[:, i - 1] += digits[:, i] >> 16
    return digits, at, alone


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids as a run of blocks."""
    blocks = -(-len(ids) // block)
    small, index = ids.astype("<u2"), np.empty((blocks, 4), "<u4")
    words, plain = [], []
    for first in range(0, blocks, LANES):
        own = ids[first * block : (first + LANES) * block]
        lanes = -(-len(own) // block)
        padded = np.zeros(lanes * block, np.int32)
        padded[: len(own)] = own
        rows = padded.reshape(lanes, block)[:, : len(own) if lanes == 1 else block]
        digits, at, alone = _coded(np.ascontiguousarray(rows.T))
        words += [(digits[i, : at[i]] & 0xFFFF).astype("<u2").tobytes() for i in range(lanes)]
        plain.append(rows[alone.T].astype("<u2").tobytes())
        index[first : first + lanes, 1], index[first : first + lanes, 2] = at, alone.sum(0)
    for i in range(blocks):
        own = small[i * block : (i + 1) * block]
        index[i, 0], index[i, 3] = len(own), zlib.crc32(own.tobytes())
    return b"".join([_HEAD.pack(MAGIC, VERSION, blocks), index.tobytes(), *words, *plain])


def _decoded(words: np.ndarray, at: np.ndarray, plain: np.ndarray, next_plain: np.ndarray, block: int) -> np.ndarray:
    """The ids of some blocks, a row for each step, from where their digits and their unpredicted ids start."""
    lanes = len(at)
    code = words.take(at, mode="clip") << np.uint32(16) | words.take(at + 1, mode="clip")
    at, next_plain = at + 2, next_plain.copy()
    width = np.full(lanes, 0xFFFFFFFF, np.uint32)
    model, out = _Model(lanes), np.empty((block, lanes), np.int32)
    for now in out:
        model.predict()
        shares = model.shared(width)
        past = (shares[1:4] <= code).view(np.uint8)
        event = past[0] + past[1]
        event += past[2]
        place = event * np.int64(lanes)
        place += model.lane
        start = shares.take(place, mode="clip")
        plain.take(next_plain, out=model.says[3], mode="clip")
        next_plain += event == 3
        model.says.take(place, out=now, mode="clip")
        place += lanes
        np.subtract(shares.take(place, mode="clip"), start, out=width)
        code -= start
        some = np.flatnonzero(width < 65536)
        code[some] = code[some] << np.uint32(16) | words.take(at[some], mode="clip")
        width[some] <<= np.uint32(16)
        at[some] += 1
        model.learn(event, now)
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of a run of blocks; raises ``Damaged`` when a checksum does not fit."""
    if len(data) < _HEAD.size or data[:4] != MAGIC:
        raise Damaged("not a run of blocks")
    _, version, blocks = _HEAD.unpack_from(data)
    if version != VERSION:
        raise Damaged(f"unknown version {version}")
    if not blocks:
        return np.zeros(0, np.uint32)
    if len(data) < _HEAD.size + 16 * blocks:
        raise Damaged("cut short")
    index = np.frombuffer(data, "<u4", 4 * blocks, _HEAD.size).reshape(blocks, 4).astype(np.int64)
    at, next_plain = offsets(index[:, 1]), offsets(index[:, 2])
    if len(data) != _HEAD.size + 16 * blocks + 2 * (at[-1] + next_plain[-1]):
        raise Damaged("cut short")
    both = np.frombuffer(data, "<u2", int(at[-1] + next_plain[-1]), _HEAD.size + 16 * blocks)
    words = np.concatenate([both[: at[-1]], np.zeros(4, "<u2")]).astype(np.uint32)
    plain = np.concatenate([both[at[-1] :], np.zeros(1, "<u2")]).astype(np.int32)
    found = []
    for first in range(0, blocks, LANES):
        some = slice(first, min(first + LANES, blocks))
        ids = _decoded(words, at[some], plain, next_plain[some], int(index[some, 0].max())).T
        for i, own in enumerate(ids, first):
            found.append(own[: index[i, 0]].astype("<u2"))
            if zlib.crc32(found[-1].tobytes()) != index[i, 3]:
                raise Damaged(f"block {i} does not match its checksum")
    return np.concatenate(found).astype(np.uint32)
