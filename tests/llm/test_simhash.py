import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from werkbank.llm import simhash
from werkbank.llm.common import connected_components


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [words[i:i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and near(a, b):
                    label[a], changed = label[b], True
    return label


def test_query_equals_brute_force(spark, sf, documents):
    prints = {i: brute_print(t) for i, t, _ in documents}
    label = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 3000), st.integers(0, 3))
def test_trie_join_finds_all_pairs(seed, pairs, distance):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64)) for _ in range(8)]))
    groups = rng.integers(0, 3, len(values))
    order = np.lexsort((values, groups))
    groups, values = groups[order], values[order]
    before, simhash.PAIRS = simhash.PAIRS, pairs
    try:
        found = {(min(a, b), max(a, b)) for x, y in simhash.trie_pairs(groups, values, distance) for a, b in zip(x.tolist(), y.tolist())}
    finally:
        simhash.PAIRS = before
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if groups[a] == groups[b]
            and int(values[a] ^ values[b]).bit_count() <= distance}
    assert found == want


@pytest.mark.parametrize("piece", [4, 1024])
def test_links_of_crowded_blocks(spark, monkeypatch, piece):
    """Chains and clusters that share blocks, also where each group is cut into many pieces."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "ROWS", 40)
    rng = np.random.default_rng(5)
    values = {0, -1}
    for _ in range(5):
        x = int(rng.integers(-2 ** 62, 2 ** 62))
        for _ in range(12):
            values.add(x)
            x ^= sum(1 << int(b) for b in rng.integers(0, 62, 3))
    values = sorted(values)
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = brute_components(values, lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3)
    assert {v: got.get(v, v) for v in values} == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (None, 5), (7, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == 12
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[2, zero] == by[3, zero] == by[4, zero] == by[None, zero] == 2
    same = f"{brute_print('a b c d'):016x}"
    assert by[1, same] == by[8, same] == by[None, same] == 1
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # One row of each component: id 1 names two of them, and the rows without an id are copies.
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in rows) == [
        (1, "a b c"), (1, "other"), (2, ""), (5, "xxxxx"), (6, "long "), (7, "Größe")]


def test_dedup_keeps_one_row_of_each_component(make):
    """One id in several components names them all, and rows without an id are copies like others."""
    a, b, c, d = "a b c d", "other words here", "only without an id", "one text of two"
    rows = [(1, a), (1, b), (1, d), (1, d), (5, b), (6, b), (8, a), (None, a), (None, a), (None, c), (None, c), (None, c), (9, d)]
    assert len({brute_print(t) for t in (a, b, c, d)}) == 4
    kept = simhash.simhash_dedup(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (0, c), (1, d)])


def test_empty_table(make):
    empty = make([(1, "x")]).where("false")
    assert simhash.simhash_components(empty).count() == 0 == simhash.simhash_dedup(empty).count()
