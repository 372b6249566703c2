import re

import numpy as np
import pytest

from werkbank.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return words, places


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in licenses.op9_licenses(spark, sf).collect()}
    assert len(rows) == len(documents)
    for i, text, _ in documents:
        (words, places), r = plain(text), rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",") if r["labels"] else [])
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("label,notice", licenses.NOTICES)
def test_each_notice_is_found_where_it_stands(make, label, notice):
    text = "Some words before it. " + notice.replace(" ", " \n ", 3).upper() + " And some words behind, too."
    (row,) = licenses.license_scan(make([(1, text)])).collect()
    n = len(licenses.words(notice.encode()))
    assert label in row["labels"]
    assert any(s["label"] == label and s["first"] <= 4 + 1 and s["last"] >= 4 + n - 2 and s["agreed"] >= 0.8 for s in row["spans"])


def test_a_changed_word_shifts_the_diagonal(make):
    """A word more moves what follows to the next diagonal; the span is still one."""
    notice = next(t for label, t in licenses.NOTICES if label == "bsd")
    text = notice.replace("binary forms", "any binary forms")
    (row,) = licenses.license_scan(make([(1, text)])).collect()
    assert row["labels"] == ["bsd"] and len(row["spans"]) == 1


def test_few_shared_words_are_no_notice(make):
    text = "Permission is hereby granted to all of you. " + "Nothing else is said. " * 20
    (row,) = licenses.license_scan(make([(1, text)])).collect()
    assert row["labels"] == [] and row["spans"] == []


def test_repeated_notices(make):
    (row,) = licenses.license_scan(make([(1, "Released under the MIT License. " * 500)])).collect()
    assert len(row["bases"]) == 500 and [s["first"] for s in row["spans"] if s["agreed"] == 1] == [5 * i for i in range(500)]


def test_odd_rows(make, odd):
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == 12 and all(r["labels"] == [] for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    twice = licenses.license_scan(make([(1, "MIT License"), (1, "MIT License"), (None, "MIT license.")])).collect()
    assert [r["labels"] for r in twice] == [["mit"]] * 3
    assert licenses.license_scan(odd.where("false")).count() == 0


@pytest.mark.parametrize("times", [1, 4, 5, 6, 40])
def test_a_notice_beside_its_own_repeated_phrase(make, times):
    """The phrase makes a chain of neighbouring diagonals that fails as a whole; the notice holds on its own."""
    text = "This is free and unencumbered software released into the public domain." + " the public domain" * times
    (row,) = licenses.license_scan(make([(1, text)])).collect()
    assert row["labels"] == ["unlicense"]
    assert [(s["first"], s["agreed"]) for s in row["spans"] if s["label"] == "unlicense"][0] == (0, 1.0)


def test_spans_of_a_notice_do_not_overlap(make):
    notice = licenses.NOTICES[3][1]
    text = notice.replace("free of charge", "free of any charge") + " x " + notice + " y " + notice[:200]
    (row,) = licenses.license_scan(make([(1, text)]), notices=[("mit", notice)]).collect()
    spans = sorted((s["first"], s["last"]) for s in row["spans"])
    assert len(spans) == 2 and spans[0][1] < spans[1][0]


def brute_agreed(text, notice):
    """The best share that any diagonal reaches alone: words agreed in runs of three."""
    words, own = plain(text)[0], [w.decode() for w in licenses.words(notice.encode())]
    best = 0.0
    for d in range(-len(own), len(words)):
        hits = [p for p in range(len(own) - 2) if 0 <= d + p and words[d + p:d + p + 3] == own[p:p + 3]]
        if hits:
            agreed = {p + i for p in hits for i in range(3)}
            best = max(best, len(agreed) / max(len(own), max(hits) + 3 - min(hits)))
    return best


def test_labels_of_documents_against_all_diagonals(spark, sf, documents):
    """A notice that one diagonal bears out is always labelled, and no label comes without most of its words."""
    rows = {r["doc_id"]: r["labels"].split(",") for r in licenses.op9_licenses(spark, sf).collect()}
    some = [(i, t) for i, t, _ in documents if "icen" in (t or "") or "ermission" in (t or "") or i % 9 == 0]
    for i, text in some:
        base = {label for _, label in plain(text)[1]}
        found = {label for label, notice in licenses.NOTICES if brute_agreed(text or "", notice) >= licenses.SHARE}
        assert found | base <= set(rows[i]) | {""}


def test_runs_are_words_and_no_mere_hashes():
    number = licenses.numbering(licenses.PHRASES, licenses.NOTICES)
    codes = np.array([[1, 2, 3, 1, 2, 4, 0, 1, 2, 3]], np.uint64)[0]
    runs = licenses.run_hashes(codes, 3, len(number) + 1).tolist()
    base = len(number) + 1
    assert runs == [(a * base + b) * base + c for a, b, c in zip(codes.tolist(), codes.tolist()[1:], codes.tolist()[2:])]
    with pytest.raises(ValueError):
        licenses.run_hashes(codes, 3, 2 ** 21)
