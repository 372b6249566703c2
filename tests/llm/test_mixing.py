import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from werkbank.llm import mixing


def test_targets_share_what_is_over():
    sizes = {"b": 10, "a": 100, None: 50}  # weights: a 1, b 2, null 3
    got = mixing.targets(sizes, (1, 2, 3), 3)
    assert got["b"] == 30 and sum(got.values()) == pytest.approx(160)
    assert got[None] == pytest.approx(97.5) and got["a"] == pytest.approx(32.5)


def test_targets_of_empty_sources():
    assert mixing.targets({"a": 0, "b": 0}, (1, 2, 3), 3) == {"a": 0, "b": 0}
    assert mixing.targets({}, (1, 2, 3), 3) == {}
    assert mixing.targets({"a": 0, "b": 8}, (5, 1), 3) == {"a": 0, "b": 8}


def cheapest(capacity, members, quota, most):
    """Least cost of the largest flow, by trying all whole amounts."""
    best = None
    patterns = list(capacity)
    for amounts in product(*(range(most * capacity[p] + 1) for p in patterns)):
        cost = sum(max(0, a - capacity[p] * r) for p, a in zip(patterns, amounts) for r in range(most))

        def fits(i, left):
            if i == len(patterns):
                return True
            return any(fits(i + 1, left | {s: left[s] - amounts[i]}) for s in members[patterns[i]] if left[s] >= amounts[i]) \
                or (len(members[patterns[i]]) == 2 and any(
                    fits(i + 1, left | {a: left[a] - k, b: left[b] - amounts[i] + k})
                    for a, b in [members[patterns[i]]] for k in range(amounts[i] + 1)
                    if left[a] >= k and left[b] >= amounts[i] - k))
        if fits(0, dict(quota)):
            key = (-sum(amounts), cost)
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("quota", [{"a": 4, "b": 5}, {"a": 9, "b": 1}, {"a": 0, "b": 3}, {"a": 20, "b": 20}])
def test_flow_is_cheapest(quota):
    capacity, members = {"A": 2, "B": 1, "AB": 2}, {"A": ["a"], "B": ["b"], "AB": ["a", "b"]}
    given = mixing.route(capacity, members, quota, 3)
    assert all(given[p] <= 3 * c for p, c in capacity.items())
    cost = sum(max(0, given[p] - capacity[p] * r) for p in capacity for r in range(3))
    assert (-sum(given.values()), cost) == cheapest(capacity, members, quota, 3)


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in mixing.op4_mixing(spark, sf).collect()}
    assert len(rows) == len(documents)
    sizes = {}
    for i, text, source in documents:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert rows[i]["size"] == size and 0 <= rows[i]["taken"] <= 3 * size
        sizes[source] = sizes.get(source, 0) + size
    goal = mixing.targets(sizes, (1, 2, 3), 3)
    for source in sizes:
        own = [rows[i] for i, _, s in documents if s == source]
        assert {(r["source_size"], r["target"]) for r in own} == {(sizes[source], goal[source])}
        assert abs(sum(r["taken"] for r in own) - goal[source]) <= 1
        # Copies are spread: no document twice before each is taken once, and one is cut at most.
        spread = {r["taken"] // r["size"] for r in own if r["size"] and r["taken"] % r["size"] == 0}
        assert max(spread) - min(spread) <= 1
        assert sum(r["size"] > 0 and r["taken"] % r["size"] > 0 for r in own) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.op4_mixing(spark, sf).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_border_is_found_at_any_width(spark, make, monkeypatch, bits):
    monkeypatch.setattr(mixing, "BITS", bits)
    docs = make([(i, "w " * (i % 7), "ab"[i % 2]) for i in range(60)])
    rows = mixing.mix_sources(docs).collect()
    for source, part in (("a", 1), ("b", 2)):
        own = [r["_mix"] for r in rows if r["source"] == source]
        whole = sum(r["_mix"]["size"] for r in rows)
        assert abs(sum(m["taken"] for m in own) - whole * part / 3) <= 1


def test_overlapping_sources(make):
    docs = make([(i, "one two three four") for i in range(30)])
    members = F.when(F.col("doc_id") < 10, F.array(F.lit("a"))).when(
        F.col("doc_id") < 20, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit(None)))
    rows = mixing.mix_sources(docs, members, weights=(1, 1, 1)).collect()
    taken = [sum(r["_mix"]["taken"] for r in rows if lo <= r["doc_id"] < lo + 10) for lo in (0, 10, 20)]
    assert sum(taken) == sum(round(t) for t in mixing.targets({"a": 80, "b": 80, None: 40}, (1, 1, 1), 3).values())
    assert all(t <= 120 for t in taken)


def test_odd_rows(odd):
    rows = mixing.mix_sources(odd)
    assert rows.columns == [*odd.columns, "_mix"]
    rows = rows.collect()
    assert len(rows) == 12 and all(r["_mix"]["taken"] <= 3 * r["_mix"]["size"] for r in rows)
    assert all(r["_mix"]["size"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.repeated(odd).columns == odd.columns


def test_repeated_documents(make):
    docs = make([(1, "a b c", "x"), (2, "d " * 30, "y"), (3, "", "y")])
    rows = mixing.repeated(docs, weights=(1, 1)).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 1, 2]


def test_many_sources_as_a_table(make):
    """Beyond the bound of the flow on the driver: targets and words of every source are the same."""
    sizes = [0, 1, 2, 50, 7, 300, 4, 4, 90, 1]
    docs = make([(100 * i + j, "w " * (n // 3 if j else n - 2 * (n // 3)), None if i == 9 else f"s{i}") for i, n in enumerate(sizes) for j in range(3)])
    read = lambda **settings: {r["doc_id"]: r["_mix"] for r in mixing.mix_sources(docs, **settings).collect()}
    few, many = read(), read(max_patterns=4)
    for i in few:
        assert (many[i]["size"], many[i]["source_sizes"]) == (few[i]["size"], few[i]["source_sizes"])
        assert many[i]["targets"][0] == pytest.approx(few[i]["targets"][0])
    for i in range(len(sizes)):
        own = [sum(m[100 * i + j]["taken"] for j in range(3)) for m in (few, many)]
        assert abs(own[0] - own[1]) <= 1 and all(m[100 * i + j]["taken"] <= 3 * m[100 * i + j]["size"] for m in (few, many) for j in range(3))


def test_too_many_overlapping_patterns_and_no_rows(make):
    docs = make([(i, "w", f"s{i}") for i in range(5)])
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, F.array("source", F.lit("all")), max_patterns=4)
    assert mixing.mix_sources(docs.where("false")).count() == 0 == mixing.mix_sources(docs.where("false"), max_patterns=-1).count()
