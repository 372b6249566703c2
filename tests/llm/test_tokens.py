import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from werkbank.llm import simple8b, tokens
from werkbank.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)), max_size=300), st.integers(1, 9))
def test_round_trip(values, times):
    values = np.array(values * times, np.uint64)
    words, starts, escapes = simple8b.encode(values)
    assert np.array_equal(simple8b.decode(words, starts, escapes, len(values)), values)


@pytest.mark.parametrize("n", [0, 1, 240, 1023, 1024, 1025, 2048])
def test_runs_of_zeros_and_block_borders(n):
    values = np.zeros(n, np.uint64)
    words, starts, escapes = simple8b.encode(values)
    assert len(starts) == -(-n // simple8b.BLOCK) and not len(escapes)
    assert len(words) <= len(starts) * 5
    assert np.array_equal(simple8b.decode(words, starts, escapes, n), values)


def test_a_block_decodes_alone():
    values = np.arange(3000, dtype=np.uint64)
    words, starts, escapes = simple8b.encode(values)
    part = words[starts[1]:starts[2]]
    assert np.array_equal(simple8b.decode(part, np.zeros(1, np.uint32), escapes, 1024), values[1024:2048])


def test_escapes():
    values = np.array([2 ** 60 - 2, 2 ** 60 - 1, 2 ** 60, 5, 2 ** 64 - 1], np.uint64)
    words, starts, escapes = simple8b.encode(values)
    assert len(escapes) == 3
    assert np.array_equal(simple8b.decode(words, starts, escapes, 5), values)


def expected(texts):
    model = Tokenizer.from_file(PATH)
    return [[*x.ids, 0] for x in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_equals_the_library(spark, sf, documents):
    rows = {r["doc_id"]: r for r in tokens.op2_tokens(spark, sf).collect()}
    start = 0
    for (i, _, _), ids in zip(documents, expected([t for _, t, _ in documents])):
        assert rows[i].asDict() == {"doc_id": i, "start": start, "n_tokens": len(ids),
                                    "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def split(texts):
    ids, counts = tokens.encoded(texts, PATH)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_spaces_and_special_strings():
    texts = ["", " ", "  a  b ", "a\n\n b\t\tc \n d", "x<|endoftext|>y", "a\x1cb \x1d c", "a b　 c d", "it's  we'll",
             "\r\n \r\n", "日本 語 😀‍", "\x85 a \x85b", " \n  <| z", "a\nb", "\na", "a\n", "a b\nc d\ne", "\0" + "1", "\v\v", "a\0b a\0c a", "\r3 \r3"]
    assert split(texts) == [e[:-1] for e in expected(texts)]


def test_what_is_remembered_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    texts = ["one two three four five six", "two two one", "seven eight"]
    assert split(texts) == [e[:-1] for e in expected(texts)]


def test_odd_rows_and_empty_table(spark, make, odd, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    path = scratch(spark, "tokens")
    tokens.write_tokens(odd, path, PATH)
    rows = sorted((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokens.read_tokens(spark, path).collect())
    assert [r[0] for r in rows] == np.cumsum([0, *(len(r[2]) for r in rows[:-1])]).tolist()
    ids = [r[1] for r in rows]
    assert ids == [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, None, None]
    assert [r[2] for r in rows if r[1] in (2, 3)] == [[0], [0]]
    path = scratch(spark, "tokens")
    tokens.write_tokens(make([(1, "x")]).where("false"), path, PATH)
    assert tokens.read_tokens(spark, path).count() == 0
