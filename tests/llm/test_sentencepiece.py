import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from werkbank.llm import sentencepieces as sp

PATH = sp.model_path()
ODD = ["", " ", "  a  b ", "\ta\n\nb　Ａ", "a" * 300, "日本語テキスト😀 é́", "x" * 60 + " y", "\x00\x01", " \n ", "ab" * 100 + "\n  "]


def ids(texts, dropout=0.0, keys=None):
    return [np.frombuffer(x, "<u4").tolist() for x in sp.encode_texts(sp.pieces(PATH), texts, keys or [0] * len(texts), dropout)]


def text_of(codes):
    return b"".join(sp.pieces(PATH).raw[i] for i in codes)[1:].decode()


def test_without_dropout_as_the_library(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for _, t, _ in documents] + ODD
    assert ids(texts) == library.encode(texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_decodes_to_the_text(texts, dropout):
    assert [text_of(c) for c in ids(texts, dropout, list(range(len(texts))))] == texts


def test_literal_marks_of_spaces():
    texts = ["▁", "a▁b ▁", " ▁ "]
    for dropout in (0.0, 0.5):
        assert [text_of(c) for c in ids(texts, dropout)] == texts


def test_dropout_varies_by_key_and_repeats(documents):
    texts = [t or "" for _, t, _ in documents[:30]]
    plain, one, again, other = ids(texts), ids(texts, 0.1, [1] * 30), ids(texts, 0.1, [1] * 30), ids(texts, 0.1, [2] * 30)
    assert one == again and one != other and one != plain
    grown = sum(map(len, one)) / sum(map(len, plain))
    assert 1.01 < grown < 1.5
    assert ids(["hello world"], 1.0) == [[i for c in "▁hello▁world" for i in [sp.pieces(PATH).symbol[ord(" " if c == "▁" else c)]]]]


def test_rounds_and_agenda_agree(documents, monkeypatch):
    texts = [t or "" for _, t, _ in documents[:20]] + ODD
    keys = list(range(len(texts)))
    for dropout in (0.0, 0.2):
        rounds = ids(texts, dropout, keys)
        monkeypatch.setattr(sp, "LONG", 1)
        assert ids(texts, dropout, keys) == rounds
        monkeypatch.undo()


def test_batches_do_not_matter(documents, monkeypatch):
    texts = [t or "" for _, t, _ in documents[:20]]
    keys = list(range(len(texts)))
    whole = ids(texts, 0.1, keys)
    monkeypatch.setattr(sp, "CHARS", 100)
    assert ids(texts, 0.1, keys) == whole


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in sp.op7_sentencepiece(spark, sf).collect()}
    assert len(rows) == len(documents) and all(r["lossless"] for r in rows.values())
    for i, t, _ in documents:
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert text_of(np.frombuffer(rows[i]["ids"], "<u4").tolist()) == (t or "") and len(rows[i]["ids"]) == 4 * rows[i]["n_ids"]
    assert all((r["n_ids"] > 0) == bool(t) for (i, t, _) in documents for r in [rows[i]])


def test_odd_rows(odd):
    frame = sp.encoded(odd, PATH)
    assert frame.columns == [*odd.columns, "_ids", "_lossless"]
    rows = frame.collect()
    assert len(rows) == 12 and all(r["_lossless"] for r in rows)
    assert all(len(r["_ids"]) == 0 for r in rows if not r["text"])
    assert len({bytes(r["_ids"]) for r in rows if r["doc_id"] == 1 and r["text"] == "a b c d"}) == 1
    assert sp.encoded(odd.where("false"), PATH).count() == 0


def brute_dropout(text, key, dropout):
    """One candidate after the other over the whole text, without rounds, heaps or units side by side."""
    model = sp.pieces(PATH)
    symbols = [(i, int(model.symbol[ord(c)])) for i, c in enumerate((" " + text) if text else "")]
    skips = {}

    def able(a):
        (i, x), (j, y) = symbols[a], symbols[a + 1]
        piece = model.merges.get((x, y))
        if piece is None:
            return None
        if (i, j, piece) not in skips:
            skips[i, j, piece] = bool(sp.skipped(np.array([key], np.int64).view(np.uint64), np.array([i]), np.array([j]), np.array([piece]), dropout)[0])
        return None if skips[i, j, piece] else (int(model.rank[piece]), i, piece, a)

    while found := [c for c in map(able, range(len(symbols) - 1)) if c]:
        _, _, piece, a = min(found)
        symbols[a:a + 2] = [(symbols[a][0], piece)]
    return [s for _, s in symbols]


def test_dropout_against_one_merge_after_the_other(documents):
    """All pieces but those that no table names; texts of known characters."""
    model = sp.pieces(PATH)
    texts = [t[:250] for _, t, _ in documents[:12] if t] + ["a b", "  x", "hello hello  hello"]
    texts = [t for t in texts if all(0 <= model.symbol[ord(c)] < model.size for c in " " + t)]
    assert len(texts) > 5
    for dropout in (0.0, 0.15, 0.5):
        for n, text in enumerate(texts):
            want = brute_dropout(text, n, dropout)
            if all(s < model.size for s in want):
                assert ids([text], dropout, [n])[0] == want


def test_copies_are_segmented_in_their_own_way(make):
    text = "The quick brown fox jumps over the lazy dog and runs away again. " * 5
    docs = make([(1, text), (1, text), (1, text), (2, text), (2, "other"), (2, text)]).coalesce(1)
    read = lambda **settings: [bytes(r["_ids"]) for r in sp.encoded(docs, PATH, **settings).collect()]
    plain, own = read(), read(copies=True)
    assert plain[0] == plain[1] == plain[2] and len(set(own[:3])) == 3 and own[0] == plain[0] and own[3:] == plain[3:]
    assert [text_of(np.frombuffer(i, "<u4").tolist()) for i in own] == [text, text, text, text, "other", text]


def test_decode_operator(spark, odd):
    back = sp.decoded_texts(sp.encoded(odd, PATH, dropout=0.4), PATH)
    assert back.columns == [*odd.columns, "_ids", "_lossless", "_text"]
    rows = back.collect()
    assert len(rows) == 12 and all(r["_text"] == (r["text"] or "") for r in rows)
    nothing = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, own binary")
    assert [r["_text"] for r in sp.decoded_texts(nothing, PATH, "own").collect()] == ["", ""]
    assert sp.decoded_texts(sp.encoded(odd.where("false"), PATH), PATH).count() == 0


def test_a_piece_over_a_space_is_refused(monkeypatch):
    class Odd:
        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"
        is_control = is_unknown = is_unused = is_byte = lambda self, i: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        sp.Pieces("x")
