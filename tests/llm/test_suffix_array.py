import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from werkbank.llm import repeats, suffixes


def brute(texts, length=100):
    """(kept bytes, spans) of each text, in the order given."""
    seen, out = set(), []
    for text in texts:
        covered = np.zeros(len(text) + 1, int)
        for i in range(len(text) - length + 1):
            if text[i:i + length] in seen:
                covered[i] += 1
                covered[i + length] -= 1
            seen.add(text[i:i + length])
        gone = np.r_[0, np.cumsum(covered[:-1]) > 0, 0].astype(int)
        edges = np.flatnonzero(np.diff(gone))
        out.append((bytes(b for b, g in zip(text, gone[1:-1]) if not g), edges.tolist()))
    return out


def results(frame):
    return {(r["doc_id"], r["text"]): (bytes(r["_kept"]["bytes"]), list(r["_kept"]["spans"])) for r in frame.collect()}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(2, 5), st.sampled_from([40, 64, 100, 101]))
def test_deep_shallow_order(seed, letters, length):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + letters, 600).astype(np.uint8)
    data[300:450] = data[:150]
    data = np.r_[data, np.zeros(8, np.uint8)]
    starts = rng.integers(0, 600 - length, 400)
    buckets = rng.integers(0, 3, 400)
    order, group = suffixes.deep_shallow(data, starts, buckets, length)
    keys = [(int(buckets[i]), data[starts[i]:starts[i] + length].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:])] == (group[1:] == group[:-1]).tolist()


def test_query_equals_brute_force(spark, sf, documents):
    got = {r["doc_id"]: r for r in repeats.op1_suffix_array(spark, sf).collect()}
    texts = [(t or "").encode() for _, t, _ in documents]
    assert len(got) == len(texts)
    for (i, _, _), text, (kept, spans) in zip(documents, texts, brute(texts)):
        row = got[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(text), len(text) - len(kept), len(spans) // 2)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("bucket", [1, 4096])
def test_copies_near_copies_and_shared_passages(make, monkeypatch, bucket):
    """Groups of copies, edits at all places, overlaps in a text, passages at both ends; also with every
    anchor cut string by string."""
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "ANCHORS", 50)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    base, passage = word(700), word(180)
    texts = [base, base, word(40) + passage, passage + word(60), word(30) + passage + word(30), "ab" * 200, base[:99],
             base[100:320]]
    for i in range(12):
        at = int(rng.integers(0, 699))
        texts.append(base[:at] + "#" + base[at + 1:])
    rows = list(enumerate(texts))
    got = results(repeats.without_repeats(make(rows[::-1])))
    want = brute([t.encode() for t in texts])
    assert got == {(i, t): w for (i, t), w in zip(rows, want)}


def test_long_texts_in_parts(make, monkeypatch):
    monkeypatch.setattr(repeats, "BYTES", 256)
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abc"), 3000))
    texts = [text, text[1000:] + text[:1500]]
    got = results(repeats.without_repeats(make(list(enumerate(texts)))))
    assert [got[i, t] for i, t in enumerate(texts)] == brute([t.encode() for t in texts])


def test_odd_rows(odd):
    frame = repeats.without_repeats(odd)
    assert frame.columns == [*odd.columns, "_kept"]
    rows = frame.collect()
    assert len(rows) == 12
    by = {(r["doc_id"], r["text"]): r["_kept"] for r in rows}
    assert bytes(by[2, None]["bytes"]) == b"" == bytes(by[3, ""]["bytes"])
    assert by[5, "x" * 50_000]["spans"] == [1, 50_000]
    assert bytes(by[6, "long " * 20_000]["bytes"]) == b"long "


def test_one_id_and_no_id(make):
    text, other = "abcdefghij" * 10 + "!" * 30, "klmnopqrst" * 10 + "?" * 30
    rows = repeats.without_repeats(make([(None, text), (9, text), (9, text), (9, other), (None, other)])).collect()
    spans = {(r["doc_id"], r["text"], tuple(r["_kept"]["spans"])) for r in rows}
    assert len(rows) == 5
    assert (None, text, (0, 130)) in spans and (None, other, (0, 130)) in spans
    assert all(s == () for i, _, s in spans if i == 9)


@pytest.mark.parametrize("size", [300, 400])
def test_texts_of_one_id_with_like_hashes(make, size):
    """Two texts of one id, or of none, whose hashes agree in the upper 25 bits; one repeats itself, one does not."""
    rng = np.random.default_rng(6)
    seen, pair = {}, None
    for i in range(40_000):
        text = rng.integers(97, 123, 150 if i % 2 else size).astype(np.uint8).tobytes() * (1 + i % 2)
        other = seen.setdefault(xxhash.xxh64_intdigest(text, 42) >> 39, (i, text))
        if (other[0] - i) % 2:
            pair = other[1].decode(), text.decode()
            break
    assert pair
    rows = [(i, t) for i in (5, None) for t in pair]
    for part in (rows[:2], rows[2:]):
        assert results(repeats.without_repeats(make(part))) == {(i, t): brute([t.encode()])[0] for i, t in part}


def test_empty_table(make):
    assert repeats.without_repeats(make([(1, "x")]).where("false")).count() == 0


def test_text_of_kept_bytes(make):
    """A cut through a character leaves no part of it in the text."""
    base = "ä" * 49 + "x" + "ä" * 49 + "yz"
    rows = [(1, base), (2, "Ť" + base[1:]), (3, "é" + base[1:])]
    got = {r["doc_id"]: r["_kept"]["text"] for r in repeats.without_repeats(make(rows), as_text=True).collect()}
    want = brute([t.encode() for _, t in rows])
    assert got == {i: kept.decode("utf-8", "ignore") for (i, _), (kept, _) in zip(rows, want)}
    assert any(kept != kept.decode("utf-8", "ignore").encode() for kept, _ in want)


def test_query_equals_sql(spark, sf):
    import duckdb

    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        want = sorted(con.sql(repeats.OP1_SQL).fetchall())
    rows = repeats.op1_suffix_array(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, rows.collect())) == want


def test_crowded_anchors_in_lanes(make, monkeypatch):
    """Very many contexts of one anchor, dealt over lanes and cut one by one."""
    monkeypatch.setattr(repeats, "BUCKET", 3)
    core = "the same forty bytes stand in all of them"
    texts = [f"{i:>60}{core}{i % 5:>70}" for i in range(40)]
    rows = {r["doc_id"]: r for r in repeats.without_repeats(make(list(enumerate(texts)))).collect()}
    for i, (kept, _) in enumerate(brute([t.encode() for t in texts])):
        assert bytes(rows[i]["_kept"]["bytes"]) == kept
