import math

import numpy as np
import pytest

from werkbank.llm import neighbours

KIND = "vec_id long, embedding array<float>, label int, node long, vector string, cell int, copies int, hash string"


def rows_of(vectors):
    return [(i, v, 0, 1, "own", 2, 3, "own") for i, v in vectors]


def brute(vectors, cosine=0.95):
    """n_links and component_id by position."""
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    x = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else np.full(4, np.nan)
                  for (_, v), g in zip(vectors, good)])
    linked = (x @ x.T >= cosine) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None], n).min(axis=1))
        if np.array_equal(low, label):
            break
        label = low
    ids = [i for i, _ in vectors]
    first = {k: min((ids[j] for j in range(n) if label[j] == k and ids[j] is not None), default=None) for k in set(label.tolist())}
    return linked.sum(axis=1).tolist(), [first[k] if g else i for k, g, i in zip(label.tolist(), good, ids)]


def clustered(seed, n=300):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 4))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.12, 4)]) for i in rng.permutation(n)]


@pytest.mark.parametrize("block", [16, 1024])
def test_equals_brute_force_with_full_reach(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    vectors = clustered(1)
    got = {r["vec_id"]: r for r in neighbours.embedding_components(spark.createDataFrame(rows_of(vectors), KIND), reach=1.0).collect()}
    links, components = brute(vectors)
    for (i, _), n, c in zip(vectors, links, components):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)


def test_query_finds_all_links(spark):
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, components = brute([(r["vec_id"], r["embedding"]) for r in data])
    got = {r["vec_id"]: r for r in neighbours.op3_embeddings(spark, sf).collect()}
    assert sum(got[r["vec_id"]]["n_links"] for r in data) >= 0.99 * sum(links)
    assert all(got[r["vec_id"]]["n_links"] <= n for r, n in zip(data, links))
    assert [got[r["vec_id"]]["component_id"] for r in data] == components


def test_recall_of_planted_neighbours(spark):
    """Pairs at cosines just above the limit, among random vectors of 64 dimensions."""
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(1500, 64)))
    y = rng.normal(size=x.shape)
    y = neighbours.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.951, 0.96, (len(x), 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine ** 2) * y]).tolist()
    got = neighbours.embedding_components(spark.createDataFrame(rows_of(list(enumerate(both))), KIND)).collect()
    assert sum(r["n_links"] for r in got) >= 0.98 * 3000


@pytest.mark.parametrize("pairs, dims, narrow", [(500, 8, False), (1000, 64, True), (3000, 8, False), (3000, 64, True)])
def test_all_planted_links_are_found(spark, monkeypatch, pairs, dims, narrow):
    """Pairs at cosines just above the limit, in few dimensions or with a spectrum that falls as 1/k: no link is lost."""
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    rng = np.random.default_rng(pairs + dims)
    scale = 1 / np.arange(1, dims + 1) if narrow else np.ones(dims)
    x = neighbours.unit(rng.normal(size=(pairs, dims)) * scale)
    y = rng.normal(size=x.shape) * scale
    y = neighbours.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.951, 0.96, (pairs, 1))
    vectors = np.concatenate([x, cosine * x + np.sqrt(1 - cosine ** 2) * y]).astype(np.float32)
    got = neighbours.embedding_components(spark.createDataFrame(rows_of(list(enumerate(vectors.tolist()))), KIND)).collect()
    x = neighbours.unit(vectors.astype(float))
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert want.min() > 0
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
    if pairs <= 500:
        assert {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(brute(list(enumerate(vectors.tolist())))[1]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(5, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]),
               (1, None), (2, []), (4, [0.0] * 4), (6, [nan, 0.0, 0.0, 1.0]), (7, [inf, 0.0, 0.0, 1.0]), (8, [None, 1.0, 0.0, 0.0]),
               (9, [0.0, 0.0, 0.0, 1.0]), (None, [0.0, 1.0, 0.0, 0.0]), (10, [0.0] * 4)]
    got = neighbours.embedding_components(spark.createDataFrame(rows_of(vectors), KIND)).collect()
    links, components = brute([(i, v if v is None or len(v) == 4 else None) for i, v in vectors])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(
        zip((i for i, _ in vectors), links, components), key=key)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table_and_lengths(spark):
    frame = spark.createDataFrame(rows_of([(1, [1.0, 0.0]), (2, [1.0])]), KIND)
    assert neighbours.embedding_components(frame.where("false")).count() == 0
    assert all(r["n_links"] == 0 and r["kept"] for r in neighbours.embedding_components(frame).collect())


def test_lengths_are_searched_apart(spark):
    """Vectors that are equal up to zeros at the end do not link; those of their own length do."""
    vectors = [(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0, 0.0]), (5, [2.0]), (6, [1.0, 0.0, 0.001]), (7, [-1.0])]
    got = neighbours.embedding_components(spark.createDataFrame(rows_of(vectors), KIND)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {
        1: (1, 1), 3: (1, 1), 2: (1, 2), 5: (1, 2), 4: (1, 4), 6: (1, 4), 7: (0, 7)}


def test_query_equals_sql(spark, sf):
    import duckdb

    with duckdb.connect() as con:
        con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
        want = sorted(con.sql(neighbours.OP3_SQL).fetchall())
    rows = neighbours.op3_embeddings(spark, sf).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, rows.collect())) == want
