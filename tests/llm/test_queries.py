"""The registered queries on the smallest tables: against their SQL, or against brute force where there is none."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from common_llm import groups_of
from oracle import connect, difference
from test_secrets import brute as base_spans
from test_conversations import expected as expected_repairs
from test_simhash import plain_fingerprint
from test_word_runs import expected as expected_runs
from tokenizers import Tokenizer

from askahead.llm.queries import QUERIES, SQL, token_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_simhash_bktree"](spark, SF).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == [ids[r] for r in groups_of(len(ids), links)]


def encoded(texts, name):
    tk = Tokenizer.from_file(token_file(name))
    return {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, texts):
    want, start = [], 0
    for i, ids in sorted(encoded(texts, "word_bpe_49k.json").items()):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op3_token_files"](spark, SF).collect())) == want


def test_op5(spark, texts):
    want = encoded(texts, "byte_bpe_50k.json")
    rows = QUERIES["op5_packing"](spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
        assert sum(r.length for r in parts) == len(want[i])
    for parts in by_sequence.values():
        total = sum(r.length for r in parts)
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    assert set(by_doc) == set(want)


def test_op6(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [i for i in truth if rows[i].held_out]
    assert len(held) > 80 and np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95


def test_op9(spark, texts):
    for r in QUERIES["op9_secrets"](spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]


def test_op10(spark, texts):
    rows = QUERIES["op10_pii"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        text, at, parts = texts[r.doc_id], 0, []
        for span in filter(None, r.spans.split(",")):
            _, start, end = span.split(":")
            parts.append(text[at : int(start)])
            assert text[int(start) : int(end)] not in r.text
            at = int(end)
        # All but the values is as it was; addresses may change their length.
        assert re.fullmatch(".+?".join(map(re.escape, [*parts, text[at:]])), r.text, re.S)


def test_op11(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = {r.conv_id: tuple(r) for r in QUERIES["op11_conversations"](spark, SF).collect()}
    assert got == expected_repairs(rows)


def test_op12(spark, texts):
    rows = {r.doc_id: tuple(r) for r in QUERIES["op12_word_runs"](spark, SF).collect()}
    assert set(rows) == set(texts)
    # Brute force is quadratic; long texts have a test of their own.
    assert all(rows[i] == expected_runs(i, t) for i, t in texts.items() if len(t or "") < 20_000)
