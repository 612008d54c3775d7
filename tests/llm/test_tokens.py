from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from common_llm import docs_table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from askahead.llm import token_files, tokens
from askahead.llm.queries import token_file
from askahead.llm.wavelet import WaveletMatrix

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PLAIN = {name: Tokenizer.from_file(token_file(name)) for name in FILES}
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\ta", "a\r\nb", "it's I'LL 'S don't", "a1b22 333",
    "é ñ ÜBER ß ÿ", "İstanbul ŉ ǆ", "é Å", "日本語 テスト", "x y z", "a\x1cb\x85c\x0bd", "🙂🙃 !!??",
    "<|endoftext|> <|startoftext|>", "²³¹ ¼½ ªº µ", "a-b_c.d,e;f", "''''s", "­ soft", "...   ...\n  x", "ǅ ﬀ Σς ΣΑΣ",
    "<|ENDOFTEXT|>", "a<|endoftext|>b <|startoftext|> c", "<|endoftext|", "| <|endoftext|><|endoftext|>\n",
    "a\0b", "x" * 5000, "ab " * 3000,
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = token_file(request.param)
    return tokens.Encoder(path, entries=500), Tokenizer.from_file(path)


def same(pair, text):
    got = np.frombuffer(pair[0].encode(text), tokens.ID).tolist()
    assert got == pair[1].encode(text, add_special_tokens=False).ids, text


def test_odd_texts_are_encoded_as_by_the_library(pair):
    for text in ODD:
        same(pair, text)
        same(pair, f"Some words, {text} and\n{text}more.")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'sSt1\n\t.,!éÑß² \x1ć日"), max_size=30))
def test_any_text_is_encoded_as_by_the_library(text):
    for name in FILES:
        encoder = tokens.encoder(token_file(name))
        got = np.frombuffer(encoder.encode(text), tokens.ID).tolist()
        assert got == PLAIN[name].encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids():
    for name in FILES:
        ids = np.frombuffer(tokens.encoder(token_file(name)).encode("a <|endoftext|> b"), tokens.ID).tolist()
        assert PLAIN[name].token_to_id("<|endoftext|>") in ids and len(ids) <= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 500, 49_407, 70_000]), max_size=200))
def test_wavelet_matrix_answers_as_the_list_does(ids):
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(np.array(ids, np.uint32)).to_bytes())
    assert matrix.decode().tolist() == ids
    assert [matrix.access(i) for i in range(len(ids))] == ids
    for token in {*ids, 7}:
        places = [i for i, t in enumerate(ids) if t == token]
        assert [matrix.occurrence(token, n) for n in range(len(places))] == places
        assert matrix.occurrence(token, len(places)) == -1
        lo, hi = len(ids) // 3, 2 * len(ids) // 3
        assert matrix.count(token) == len(places)
        assert matrix.count(token, lo, hi) == ids[lo:hi].count(token)
    with pytest.raises(IndexError):
        matrix.access(len(ids))


def test_large_matrix_and_bad_files():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 100_001) % 49_408).astype(np.uint32)
    data = WaveletMatrix.build(ids).to_bytes()
    matrix = WaveletMatrix.from_bytes(data)
    assert (matrix.decode() == ids).all()
    assert len(data) < 2 * len(ids)
    assert matrix.count(int(ids[77])) == int((ids == ids[77]).sum())
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"no" + data)
    with pytest.raises(ValueError):
        token_files.open_shard(b"no" * 20)


def expected(rows, name):
    tk = Tokenizer.from_file(token_file(name))
    return [(i, np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows]


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 20])
def test_files_hold_all_documents_in_order(spark, shard_tokens):
    rng = random.Random(3)
    rows = [(i * 3 - 40, " ".join(rng.choice(["a", "Bee", "the", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(70)]
    rows += [(500, None), (501, "word " * 2000)]
    rng.shuffle(rows)
    folder, manifest = token_files.write_tokens(docs_table(spark, rows), token_file(FILES[1]), shard_tokens=shard_tokens)
    got = sorted(token_files.read_tokens(folder, manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, raw) in zip(got, expected(sorted(rows, key=lambda x: x[0]), FILES[1]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += r.n_tokens
    assert sum(r.tokens for r in manifest.collect()) == start


def test_odd_rows(spark):
    rows = [(None, "b"), (None, "a"), (2, "same"), (2, "same"), (1, "z"), (3, "日本")]
    docs = docs_table(spark, rows, "id n ids part t")
    got = sorted(token_files.read_tokens(*token_files.write_tokens(docs, token_file(FILES[1]))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2, 3]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert token_files.read_tokens(*token_files.write_tokens(docs.limit(0), token_file(FILES[1]))).collect() == []
