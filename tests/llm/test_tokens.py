"""Token ids, their binary blocks and packing, against the tokenizers library and plain arithmetic."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.elias_fano import EliasFano
from sluice.llm.packing import Capacity, pack, patterns
from sluice.llm.token_binary import Block, pack_block, token_file
from sluice.llm.token_ids import TokenEncoder, default_tokenizer


@pytest.fixture(scope="module")
def encoder():
    return TokenEncoder(default_tokenizer(), bits=10)


def ids_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


PIECE = st.sampled_from(["a", "word", "Word,", "é", "中文", " ", "  ", "\n", "\t", "\r\n", "'s", "...", "12", "\x00", "\x1c", " ", " ", "<|endoftext|>", "end.\nNew", "(x)"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_are_those_of_the_library(texts):
    encoder = _ENCODER
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(encoder, text)[:-1]


_ENCODER = TokenEncoder(default_tokenizer(), bits=9)


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def test_ids_of_pieces_that_hashes_confuse():
    """Thue-Morse strings and their complements, which polynomials modulo 2^64 can't tell apart, runs without a space,
    random bytes, and pieces that differ by a NUL at their end or by one byte at the border of short and long."""
    r = np.random.default_rng(9)
    texts = [f"{thue_morse(n, *pair)} x" for n in (16, 32, 512, 1024, 2048) for a, b in (("a", "b"), ("é", "è"), ("x", "1")) for pair in ((a, b), (b, a))]
    texts += ["z" * 50_000, "é" * 3000 + " é", "=-" * 3000, r.bytes(5000).decode("latin-1"), r.bytes(5000).decode("utf-8", "replace")]
    texts += [f"x {'a' * k}{end} y" for k in range(20, 28) for end in ("", "\0", "b")] + ["a" * k + "\0" * (k % 3) for k in range(30)]
    encoder = TokenEncoder(default_tokenizer())
    for some in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == [ids_of(encoder, t)[:-1] for t in some]


def test_pieces_of_one_place_stay_apart(monkeypatch):
    """The table decides by the pieces themselves: the same with a place that says nothing."""
    from sluice.llm import token_ids

    monkeypatch.setattr(token_ids, "_mixed", lambda x: x & np.uint64(3))
    encoder = TokenEncoder(default_tokenizer(), bits=8)
    texts = [f"word{k} other{k % 7} more words here" for k in range(60)] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids_of(encoder, t)[:-1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5000), st.sampled_from([0, 1 << 20, 1 << 40, 1 << 54])), max_size=200))
def test_elias_fano_round_trips(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert code.select_many(np.arange(len(values))).tolist() == values.tolist() == [code.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small_and_checks():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 10_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < len(values) * (2.5 + math.log2((1 << 30) / len(values)))
    for wrong in ([2, 1], [-1]):
        with pytest.raises(ValueError):
            EliasFano.of(wrong)


def test_blocks_hold_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    for width in (2, 4):
        block = Block(pack_block([None, -5, 1 << 61], ids, width))
        assert [block[i].tolist() for i in range(len(block))] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]
        assert block.doc_ids(np.arange(3)) == [None, -5, 1 << 61] and [block.find(k) for k in (-5, 1 << 61, 0)] == [1, 2, None]
    with pytest.raises(ValueError):
        Block(b"nope" + bytes(20))


@pytest.mark.parametrize("block_ids", [1 << 20, 64])
def test_files_give_back_all_documents(documents, odd, encoder, tmp_path, block_ids):
    from sluice.llm.token_binary import read_documents, write_blocks

    for k, docs in enumerate((documents, odd)):
        write_blocks(docs, f"{tmp_path}/{k}", default_tokenizer(), block_ids)
        got = sorted((tuple(r) for r in read_documents(docs.sparkSession.read.parquet(f"{tmp_path}/{k}")).collect()), key=lambda r: r[1])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        start, wanted = 0, []
        for key, text in rows:
            ids = ids_of(encoder, text)
            wanted.append((key, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == wanted


def test_doc_ids_far_apart_are_in_blocks_of_their_own(spark, tmp_path):
    from sluice.llm.token_binary import read_documents, write_blocks

    keys = [-(1 << 63), -3, 0, 5, (1 << 63) - 1]
    write_blocks(spark.createDataFrame([(k, "a b") for k in keys], "doc_id long, text string").coalesce(1), f"{tmp_path}/far", default_tokenizer())
    rows = sorted(tuple(r) for r in read_documents(spark.read.parquet(f"{tmp_path}/far")).select("doc_id", "start").collect())
    assert rows == [(k, 3 * i) for i, k in enumerate(keys)]


def test_no_documents(none):
    assert token_file(none, default_tokenizer()).collect() == []
    assert pack(none, default_tokenizer()).collect() == []


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(64), Capacity(64, documents=2), Capacity(64, score="dot"), Capacity(64, attention=1000), Capacity(1)])
def test_packing_is_valid_and_tight(documents, odd, encoder, capacity):
    for docs in (documents, odd):
        pieces = pack(docs, default_tokenizer(), capacity).toPandas()
        wanted = []
        for r in docs.collect():
            ids = ids_of(encoder, r["text"])
            first = (len(ids) - 1) % capacity.tokens + 1
            cuts = [0, *range(first, len(ids), capacity.tokens), len(ids)]
            wanted += [(-1 if r["doc_id"] is None else r["doc_id"], k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = [(-1 if d != d else int(d), *r) for d, *r in pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
        assert sorted(got) == sorted(wanted)
        bins = pieces.assign(square=pieces.length**2).sort_values(["sequence_id", "offset"])
        whole = bins.groupby("sequence_id").agg(tokens=("length", "sum"), documents=("length", "size"), attention=("square", "sum"))
        assert (whole.tokens <= capacity.tokens).all() and (whole.documents <= capacity.documents).all()
        assert ((whole.documents == 1) | (whole.attention <= (capacity.attention or capacity.tokens**2))).all()
        assert (bins.offset == bins.groupby("sequence_id").length.cumsum() - bins.length).all()
        if capacity == Capacity():
            assert pieces.sequence_id.nunique() <= math.ceil(pieces.length.sum() / capacity.tokens) * 1.02 + 1


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(3)
    histogram = {int(n): int(c) for n, c in zip(rng.permutation(np.arange(1, 100))[:40], rng.integers(1, 50, 40))}
    used: dict[int, int] = {}
    for copies, bin_ in patterns(histogram, Capacity(100, documents=5, attention=10_000)):
        assert sum(n * k for n, k in bin_) <= 100 and sum(k for _, k in bin_) <= 5 and sum(n * n * k for n, k in bin_) <= 10_000
        for n, k in bin_:
            used[n] = used.get(n, 0) + copies * k
    assert used == histogram
    with pytest.raises(ValueError):
        patterns({101: 1}, Capacity(100))


def test_every_constraint_can_bind():
    histogram = {60: 10, 40: 10, 5: 40}
    bins = {k: patterns(histogram, c) for k, c in {"tokens": Capacity(100), "documents": Capacity(100, documents=2), "attention": Capacity(100, attention=3700)}.items()}
    assert bins["tokens"][0] == (10, [(60, 1), (40, 1)])
    assert all(sum(k for _, k in b) <= 2 for _, b in bins["documents"]) and bins["documents"] != bins["tokens"]
    assert all(sum(n * n * k for n, k in b) <= 3700 for _, b in bins["attention"]) and bins["attention"][0][1] == [(60, 1), (5, 4)]
    assert patterns({90: 2, 5: 2}, Capacity(100, attention=50))[0] == (2, [(90, 1)])  # too dear alone: a bin alone
