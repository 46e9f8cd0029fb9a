import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import huffman_ids as H
from rillflow.llm.bpe import ByteBPE, bpe_decode, bpe_encode, bpe_round_trip
from rillflow.llm.queries import vocabulary

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
TEXTS = ["", " ", "  a  b\n\n c", "x<|endoftext|>y <|endoftext|>", "I'll've 12345 ½ ² ٣ don't", "a\x1cb\x85c\xa0d e​f᠎g", "é" * 200, "ab" * 3000, "日本語 テキスト 😀", "ΑΣ Σ ΣΑΣ", "é! ́x", "'S 'LL", "\x00\x01 abc", "a×!! b", "≠ a≠", "don't. stop's!", "A!!» b!", "tr\n\n", "\r\n x", "<|startoftext|>A!! b"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(vocabulary("byte_bpe_50k.json"), cache=500)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words():
    return H.LibraryTokenizer(vocabulary("word_bpe_49k.json"), cache=300), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_bpe_equals_the_library(bpe, lib):
    for t, ids in zip(TEXTS, bpe.encode(TEXTS)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert bpe.decode(ids) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeETS '\n\t.,!12éß日 ́<|>"), max_size=60))
def test_bpe_equals_the_library_on_any_text(bpe, lib, text):
    ids = bpe.encode([text])[0]
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeETS '\n\t.,!12éß×日 ́<|>="), max_size=60))
def test_cached_library_equals_the_library(words, text):
    assert words[0].encode(pa.array([text]))[0].tolist() == words[1].encode(text, add_special_tokens=False).ids


def test_cached_library_on_fixed_texts(words):
    for t, ids in zip(TEXTS, words[0].encode(pa.array(TEXTS))):
        assert ids.tolist() == words[1].encode(t, add_special_tokens=False).ids


def test_cached_library_on_every_letter_and_mark(words):
    letters = [chr(c) for c in (*range(0xA0, 0x250), *range(0x41, 0x5B), *range(0x61, 0x7B))]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [t for c in letters for m in marks for t in (f"{c}{m}", f"x{c}{m} y{m}{c} {c}", f"{c}{c}{m}{m}")]
    for t, ids, want in zip(texts, words[0].encode(pa.array(texts)), words[1].encode_batch_fast(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, t


def test_other_vocabularies_encode_whole_texts(spark, lib):
    path = vocabulary("byte_bpe_50k.json")
    assert not H.LibraryTokenizer(path).divides
    where = H.write_ids(frame(spark), path, end_id=70_000, part_bytes=20_000)
    got = sorted(r["n_tokens"] for r in H.read_ids(spark, where).collect())
    assert got == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)


def test_bpe_in_spark(spark):
    path = vocabulary("byte_bpe_50k.json")
    coded = bpe_encode(frame(spark), path)
    back = rows(bpe_decode(coded, path))
    assert back == sorted(((i, t or "") for i, t in ODD), key=str)
    assert bpe_round_trip(frame(spark), path).count() == len(ODD)
    assert bpe_round_trip(frame(spark, []), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.integers(9, 14))
def test_code_lengths(counts, limit):
    lengths = H.code_lengths(np.array(counts, np.int64), limit)
    used = [n for n in counts if n]
    assert ((lengths > 0) == (np.array(counts, np.int64) > 0)).all()
    assert lengths.max(initial=0) <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    if len(used) > 1:  # optimal where the limit does not bind
        import heapq

        heap, cost = list(used), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert int((lengths * np.array(counts)).sum()) >= cost
        if limit >= len(used):
            assert int((lengths * np.array(counts)).sum()) == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_blocks_round_trip(docs, spacing):
    tokens = [np.array(d, np.uint16) for d in docs]
    counts = np.bincount(np.concatenate(tokens).astype(int), minlength=40) if sum(map(len, tokens)) else np.zeros(40, int)
    lengths = H.code_lengths(counts, 12)
    named = [None if k == 0 else k for k in range(len(docs))]
    block = H.encode_block(named, tokens, lengths, H.canonical_codes(lengths), spacing)
    ids, sizes, out = H.decode_block(block, H.decode_table(lengths))
    assert ids == named and sizes.tolist() == list(map(len, docs)) and out.tolist() == [x for d in docs for x in d]


def test_id_files(spark, words):
    where = H.write_ids(frame(spark), vocabulary("word_bpe_49k.json"), end_id=2, part_bytes=20_000, block_tokens=5000, spacing=64)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in H.ids_digest(H.read_ids(spark, where)).collect()}
    start, want = 0, {}
    for i, t in sorted(ODD, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*words[1].encode(t or "", add_special_tokens=False).ids, 2]
        want[i, start] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want
    parts = [r["part"] for r in spark.read.parquet(f"{where}/blocks").collect()]
    assert len(set(parts)) > 1
    empty = H.write_ids(frame(spark, []), vocabulary("word_bpe_49k.json"), end_id=2)
    assert H.read_ids(spark, empty).count() == 0
