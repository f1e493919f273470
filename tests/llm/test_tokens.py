"""Token counts, packing, the coder and its files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirefold.llm import codec, encoding
from quirefold.llm.binout import read_ids, write_ids
from quirefold.llm.encoding import lengths_of, segments, word_ids
from quirefold.llm.packing import Packer, pack
from quirefold.llm.tokencount import count_tokens
from tests.llm import cases

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in (BYTES, WORDS)}


def whole(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_words(texts):
    return [ids[a:b].tolist() for ids, at in word_ids(pa.array(texts, pa.string()), WORDS) for a, b in zip(at[:-1], at[1:])]


def texts_around_every_character():
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    return [f"ab{chr(c)} {chr(c)}cd {chr(c)}{chr(c)}! {chr(c)}1a" for c in points]


def test_pieces_add_up_to_the_whole(library):
    r = random.Random(4)
    texts = ["", " ", "a  b", "a   b \n c\n\n", "it's <|endoftext|> x<|endoftext|>y", "don't 'S b'll 12 34,5", "İSTANBUL Σας ΣΑΣ ǅ", "\x1c a\x1cb !\x1c?"]
    texts += ["".join(r.choice("ab 1,.'<|>é\n\t漢ß") for _ in range(60)) for _ in range(300)] + texts_around_every_character()
    assert [sum(v) for v in lengths_of(BYTES).values(texts)] == [len(i) for i in whole(library[BYTES], texts)]
    assert by_words(texts) == whole(library[WORDS], texts)
    plain = [t for t in texts if not set(t) & set("\x1c\x1d\x1e\x1f")]  # the path without a regular expression
    assert by_words(plain) == whole(library[WORDS], plain)


def test_segments_cut_before_white_space():
    text = cases.text(1, 5000)
    parts = list(segments(text, 700))
    assert "".join(parts) == text and all(p[0].isspace() for p in parts[1:]) and max(map(len, parts)) < 900
    assert list(segments("x" * 50, 7)) == ["x" * 50]


def test_a_full_cache_starts_over(library, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_ENTRIES", 20)
    texts = [cases.text(i, 40) for i in range(20)]
    assert by_words(texts) == whole(library[WORDS], texts)
    assert [sum(v) for v in lengths_of(BYTES).values(texts)] == [len(i) for i in whole(library[BYTES], texts)]


def test_words_are_made_from_their_runs(library):
    encoder = encoding._ids_of(WORDS, None)
    encoder.forget()
    texts = ["Abc abc, ABC!! 1abc1 abc", "", "Éa abc," + "x" * 70 + " don't abc", None, "É,É 11!!"]
    assert by_words(texts) == whole(library[WORDS], [t or "" for t in texts])
    assert set(encoder.parts) == {"", "abc", ",", "!!", "1", "éa", "é"}  # each run once, whatever the words around it
    assert set(encoder.seen) == {"don't"}


def test_count_tokens(spark, library):
    want = sorted(
        (str(d), len((t or "").encode()), n, n > 512)
        for (d, t, *_), n in zip(cases.rows(), map(len, whole(library[BYTES], [r[1] or "" for r in cases.rows()])))
    )
    got = count_tokens(cases.documents(spark), BYTES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert count_tokens(cases.empty(spark), BYTES).count() == 0


def check_packing(pieces, ids_of: list[list[int]], length: int):
    """Every document whole, every sequence gapless and within bounds; the share of padding."""
    by_ids = {}
    for ids in ids_of:
        by_ids.setdefault((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        documents.setdefault(p.doc_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own][:-1]]).tolist()
        assert sum(p.length for p in own) <= length
    assert sum(p.length for p in pieces) == sum(map(len, ids_of))
    assert all(p.length > 0 for p in pieces)
    return 1 - sum(map(len, ids_of)) / (len(sequences) * length), documents


def test_pack(spark, library):
    ids = {}
    for (doc_id, *_), own in zip(cases.rows(), whole(library[WORDS], [r[1] or "" for r in cases.rows()])):
        ids.setdefault(doc_id, []).append(own + [2])
    pieces = pack(cases.documents(spark), WORDS, 2, length=256, windows=4, with_ids=True).collect()
    padding, documents = check_packing(pieces, [i for own in ids.values() for i in own], 256)
    assert padding < 0.02
    for doc_id, own in documents.items():
        assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in own)
        if len(ids[doc_id]) == 1:
            own.sort(key=lambda p: p.start)
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids[doc_id][0]
            assert {p.doc_tokens for p in own} == {len(ids[doc_id][0])}
    assert pack(cases.empty(spark), WORDS, 2).count() == 0


def test_pack_merges_leftovers_of_many_tasks_over_levels(spark):
    docs = cases.documents(spark, [(i, cases.text(i, 5), "en", "a", 1, *cases.EXTRA) for i in range(300)]).repartition(150)
    pieces = pack(docs, WORDS, 2, length=64).collect()
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert sum(s < 64 - 16 for s in sizes.values()) <= 1


@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 4), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_packer_loses_nothing(lengths, windows, min_cut):
    packer = Packer(0, 16, windows, min_cut)
    for d, n in enumerate(lengths):
        packer.add(d, n, 0, np.arange(n, dtype="<u4").tobytes())
        assert len(packer.open) <= windows
    left = packer.leftover()
    got = {}
    for pieces in [*(p for _, p in packer.done), left]:
        assert sum(len(p[3]) for p in pieces) <= 64
        for d, _, start, ids in pieces:
            got.setdefault(d, []).extend(zip(range(start, start + len(ids) // 4), np.frombuffer(ids, "<u4")))
    assert {d: sorted(v) for d, v in got.items()} == {d: [(i, i) for i in range(n)] for d, n in enumerate(lengths)}


@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=300), st.integers(1, 64))
@settings(max_examples=100, deadline=None)
def test_coder_round_trip(ids, block):
    assert codec.decode(codec.encode(np.array(ids, np.uint32), block)).tolist() == ids


def test_coder_blocks_stand_alone_and_notice_damage():
    ids = np.array(random.Random(2).choices(range(500), k=9000), np.uint32)
    data = bytearray(codec.encode(ids))
    assert len(data) < len(codec.encode(np.random.default_rng(1).integers(0, 49000, 9000)))
    assert len(codec.encode(np.tile(np.arange(50), 200))) < 10_000  # predictable ids cost far less than two bytes
    data[len(data) // 2] ^= 1
    with pytest.raises(codec.Damaged):
        codec.decode(bytes(data))
    for bad in (b"", b"nope", bytes(data[:-1])):
        with pytest.raises(codec.Damaged):
            codec.decode(bad)


def test_coder_takes_any_number_of_blocks_at_a_time(monkeypatch):
    ids = np.random.default_rng(3).zipf(1.3, 5000).clip(0, 65535).astype(np.uint32)
    data = codec.encode(ids, 100)
    monkeypatch.setattr(codec, "LANES", 7)
    assert codec.encode(ids, 100) == data
    assert codec.decode(data).tolist() == ids.tolist()


def test_ids_that_nobody_predicted_cost_sixteen_bits():
    ids = np.random.default_rng(4).permutation(65536).astype(np.uint32)
    plain = np.frombuffer(codec.encode(ids), "<u2")[-len(ids) :]
    assert plain.tolist() == ids.tolist()  # beside the coder's digits, as they are


def test_files(spark, library, tmp_path):
    path = str(tmp_path / "ids")
    write_ids(cases.documents(spark), path, WORDS, 1, group_ids=2000)
    got = sorted(read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    order = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, row, ids in zip(got, order, whole(library[WORDS], [r[1] or "" for r in order])):
        want = np.array([*ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(want), zlib.crc32(want.tobytes()))
        assert bytes(r.ids) == want.tobytes()
        at += len(want)
    assert len(got) == len(order)
    write_ids(cases.empty(spark), str(tmp_path / "none"), WORDS, 1)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0
