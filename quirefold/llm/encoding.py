"""Tokenizers inside tasks: pieces between safe cuts, encoded once and kept.

Both public BPE files first split a text so that no token spans the border between a
character and white space behind it. A text may therefore be cut before any run of white
space, and equal pieces give equal ids. Pieces are encoded in batches balanced by bytes;
a bounded cache keeps what a worker has seen.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quirefold.llm.common import CACHE_ENTRIES, hold, offsets

# The white space of Unicode (property White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BARE = re.compile(f"[^{SPACE}]+")
CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")
# The word vocabulary lowers each character and takes runs of letters, single digits and runs
# of other signs apart. Below U+0180 that needs no normalising; the apostrophe (it starts
# runs of its own) and "<" (special strings) are left to the library, as is the capital
# dotted I, which lowers to two characters.
_LETTERS, _DIGITS = ("".join(rf"\x{{{c:x}}}" for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN")
ODD = r"['<\x{130}\x{180}-\x{10FFFF}]"
NO_LETTERS = f"([{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+)"
#: Characters of text that are worked on at a time, and bytes in one call of the library.
SEGMENT, BATCH_BYTES = 1 << 20, 1 << 18
#: Longer pieces are encoded but not kept.
KEEP_CHARS = 64
#: The vocabulary whose ids never cover white space, and bytes of text whose ids are made together.
WORDS, ROWS_BYTES = "word_bpe_49k.json", 4 << 20
#: Runs of letters, digits or signs in one line for the library, and in one call.
LINE, CALL = 512, 1 << 14


def load(name: str):
    """The tokenizer behind a file name of the vocabulary folder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut only before white space."""
    at = 0
    while len(text) - at > limit:
        found = CUT.search(text, at + limit - 1)
        if found is None:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def balanced(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The pieces in lists of about ``limit`` bytes."""
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece)
        size += len(piece.encode("utf-8", "replace"))
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Encoder:
    """What ``keep`` makes of the ids of each piece; values of short pieces are remembered, within bounds."""

    def __init__(self, name: str, keep, remembered: int | None = None) -> None:
        self.name, self.tokenizer, self.keep, self.remembered = name, load(name), keep, remembered
        self.cuts = not name.endswith(".model")
        self.seen: dict[str, object] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.closing: np.ndarray | None = None

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        if not self.cuts:
            return self.tokenizer.encode(pieces, num_threads=1)
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encoded(self, pieces) -> Iterator[tuple[str, object]]:
        for batch in balanced(list(pieces)):
            yield from zip(batch, map(self.keep, self._ids(batch)))

    def _encoded_runs(self, runs: list[str]) -> Iterator[bytes]:
        """Runs go through the library many to a line; the ids that end a run tell them apart again."""
        ends, tokenizer = self._ends(), _split_tokenizer(self.name)
        for first in range(0, len(runs), CALL):
            batch = runs[first : first + CALL]
            lines = [" ".join(batch[i : i + LINE]) for i in range(0, len(batch), LINE)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cut = np.flatnonzero(ends[ids]) + 1
            if len(cut) != len(batch):
                raise ValueError(f"{len(batch)} runs gave {len(cut)} ends")
            raw, at = ids.tobytes(), [0, *(cut * 4).tolist()]
            yield from [raw[a:b] for a, b in zip(at, at[1:])]

    def _make_room(self, fresh: int) -> bool:
        """Whether all was forgotten because this many new values would be too many."""
        full = len(self.seen) + len(self.parts) + fresh > (self.remembered or CACHE_ENTRIES)
        if full:
            self.forget()
        return full

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without odd characters, and how many each has, by their runs, which repeat far more."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), NO_LETTERS, r" \1 "))
        coded = lists.flatten().dictionary_encode()
        # far faster than to_pylist
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hold(f"pieces of {id(self)}", self.forget)
        values = list(map(self.parts.get, distinct))
        fresh = [i for i, value in enumerate(values) if value is None]
        for i, value in zip(fresh, self._encoded_runs([distinct[i] for i in fresh])):
            values[i] = value
        if self._make_room(len(fresh)):
            self.parts.update(zip(distinct, values))
        else:
            self.parts.update((distinct[i], values[i]) for i in fresh)
        ids, lengths = _taken(values, coded.indices.to_numpy())
        ends = offsets(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return ids, np.diff(offsets(lengths)[ends])

    def pooled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words of the word vocabulary: all of them, where each word's begin, and how many it has."""
        odd = pc.or_(pc.match_substring_regex(words, ODD), pc.greater(pc.utf8_length(words), KEEP_CHARS))
        rare = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        pool, lengths = self._plain(words.filter(pc.invert(odd)) if len(rare) else words)
        if not len(rare):
            return pool, offsets(lengths)[:-1], lengths
        strange = words.take(pa.array(rare)).to_pylist()
        more, own = _taken(list(map(self.lookup(set(strange)).__getitem__, strange)), np.arange(len(rare)))
        usual = np.delete(np.arange(len(words)), rare)
        order = np.concatenate([usual, rare])
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[order] = np.concatenate([lengths, own])
        begin[order] = offsets(count[order])[:-1]
        return np.concatenate([pool, more]), begin, count

    def _ends(self) -> np.ndarray:
        """Which ids close a run: their text carries the vocabulary's word end."""
        if self.closing is None:
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for text, i in self.tokenizer.get_vocab().items() if text.endswith("</w>")]] = True
        return self.closing

    def forget(self) -> None:
        self.seen, self.parts = {}, {"": b""}

    def lookup(self, pieces: set[str]):
        """A mapping that has the values of all these pieces."""
        hold(f"pieces of {id(self)}", self.forget)
        fresh = pieces.difference(self.seen)
        if self._make_room(len(fresh)):
            fresh = pieces
        once = {}
        for piece, value in self._encoded(fresh):
            (self.seen if len(piece) <= KEEP_CHARS else once)[piece] = value
        if not once:
            return self.seen
        return {**once, **{p: self.seen[p] for p in pieces if p not in once}}

    def _group(self, texts: list[str]) -> Iterator[list]:
        split = [PIECE.findall(t) if self.cuts else [t] for t in texts]
        look = self.lookup(set().union(*split)).__getitem__
        for pieces in split:
            yield list(map(look, pieces))

    def values(self, texts: list[str | None]) -> Iterator[list]:
        """Per text the kept values of its pieces, in order; a null text counts as empty."""
        group, size = [], 0
        for text in texts:
            if text is not None and len(text) > SEGMENT and self.cuts:
                if group:
                    yield from self._group(group)
                    group, size = [], 0
                whole: list = []
                for part in segments(text):
                    whole.extend(next(self._group([part])))
                yield whole
                continue
            group.append(text or "")
            size += len(group[-1])
            if size >= SEGMENT:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


@lru_cache(maxsize=1)
def _split_tokenizer(name: str):
    """The library's tokenizer for runs that are normal and told apart already: between spaces it only merges."""
    from tokenizers import pre_tokenizers

    tokenizer = load(name)
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def _taken(values: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these values in the order of ``which``, and how many each one takes."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return _gathered(np.frombuffer(b"".join(values), "<u4"), offsets(lengths)[:-1], lengths, which)


def _gathered(pool: np.ndarray, begin: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taken = lengths[which]
    to = offsets(taken)
    return pool[np.repeat(begin[which] - to[:-1], taken) + np.arange(to[-1])], taken


@lru_cache(maxsize=4)
def lengths_of(name: str) -> Encoder:
    """Number of ids of each piece; one encoder per worker."""
    return Encoder(name, len)


@lru_cache(maxsize=4)
def _ids_of(name: str, remembered: int | None) -> Encoder:
    """Ids of each piece as little-endian bytes."""
    return Encoder(name, lambda ids: np.array(ids, "<u4").tobytes(), remembered=remembered)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    # Arrow, like Python, takes four control characters for white space that the library does not
    if pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]")).as_py():
        split = [BARE.findall(t) for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(split)), pa.string()), np.array([len(w) for w in split], np.int64)
    lists = pc.utf8_split_whitespace(texts)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def word_ids(column: pa.Array, name: str, remembered: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of texts under the word vocabulary, for some rows at a time: all ids, and where each text starts.

    Words and their runs are told apart by Arrow; Python sees each distinct run of the rows
    once, and a worker keeps the ids of ``remembered`` of them (about 170 bytes each).
    """
    if name != WORDS:
        raise ValueError(f"white space may carry ids in {name}")
    column = column.fill_null("")
    sizes, at = pc.binary_length(column).to_numpy(zero_copy_only=False), 0
    while at < len(column):
        end, size = at, 0
        while end < len(column) and (size < ROWS_BYTES or end == at):
            size += int(sizes[end])
            end += 1
        words, per_text = _words(column.slice(at, end - at))
        coded = words.dictionary_encode()
        pool, begin, lengths = _ids_of(name, remembered).pooled(coded.dictionary)
        ids, taken = _gathered(pool, begin, lengths, coded.indices.to_numpy())
        yield ids, offsets(taken)[offsets(per_text)]
        at = end
