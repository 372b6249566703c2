import zlib

import numpy as np
import pytest

from werkbank.llm import quality


def test_held_out_accuracy(spark):
    """On labels that the model may not see."""
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert len(held) > 80
    assert np.mean([p for p, q in held if q]) > 0.93
    assert np.mean([p for p, q in held if not q]) < 0.1


def test_risk_needs_no_negatives():
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(0, 1, (n, 3))
    bad = lambda n: rng.normal(3, 1, (n, 3))
    model = quality.fit(good(500), np.concatenate([good(700), bad(300)]), 0.7)
    assert (quality.raw_score(model, good(300)) > 0).mean() > 0.93
    assert (quality.raw_score(model, bad(300)) > 0).mean() < 0.1


def test_fit_repeats():
    x = np.random.default_rng(1).normal(size=(60, 4))
    a, b = (quality.fit(x[:20], x, 0.5) for _ in range(2))
    assert all(np.array_equal(p, q) for p, q in zip(a, b))


def test_features_have_one_width():
    for text in (None, b"", b" \n ", b"a", b"\xff\xfe", "Größe 日本".encode(), b"x" * 100_000):
        found = quality.features(text)
        assert len(found) == quality.WIDTH and np.isfinite(found).all()


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, q, 0) for i, q in ((1, 1), (3, 1), (5, 0), (6, 0), (8, 1), (8, 0), (None, 1), (2, None))],
                                 "doc_id long, quality int, toxic int")


def test_odd_rows(odd, labels):
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["score"]), []).append(r)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert quality.good_documents(odd, labels).columns == odd.columns


def test_nothing_to_learn(odd, labels):
    rows = quality.quality_scores(odd, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}
    assert quality.quality_scores(odd.where("false"), labels).count() == 0


def test_an_id_counts_once_and_order_does_not_matter(make, labels, monkeypatch):
    """A hot id brings one row to the fit, and its text of smallest hash, whatever the order of rows."""
    texts = [(1, "good text one. " * 9), (1, "other text of the id | | |"), (3, "good text three. " * 7), (5, "BAD!! " * 30), (6, "| | x " * 30)]
    rows = texts + [(1, texts[0][1])] * 500 + [(i, f"free text number {i}. " * 5) for i in range(20, 60)]
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: seen.append((len(a[0]), len(a[1]))) or fit(*a, **k))
    one = quality.quality_scores(make(rows), labels).orderBy("doc_id", "score").collect()
    two = quality.quality_scores(make(rows[::-1]).repartition(5), labels).orderBy("doc_id", "score").collect()
    assert one == two
    trusted = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (1, 3))
    assert trusted > 0 and set(seen) == {(trusted, 44)}


def test_samples_are_bounded(make, labels, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: seen.append((len(a[0]), len(a[1]))) or fit(*a, **k))
    quality.trained(make([(i, f"text {i} " * 5) for i in range(50)] * 3), labels, positives=1, unlabelled=10)
    assert seen == [(1, 10)]


def test_fit_lowers_the_risk():
    """The fitted net has a lower risk than a random one, with a small and with a large prior."""
    rng = np.random.default_rng(8)
    good, free = rng.normal(size=(12, 4)) + 1, rng.normal(size=(30, 4))
    for prior in (0.3, 0.99):
        centre, scale = free.mean(axis=0), free.std(axis=0) + 1e-6
        z = [np.clip((x - centre) / scale, -6, 6) for x in (good, free)]

        def risk(model):
            bad = [1 / (1 + np.exp(-(np.tanh(x @ model.first + model.first_bias) @ model.second + model.second_bias))) for x in z]
            return prior * (1 - bad[0]).mean() + max(0.0, bad[1].mean() - prior * bad[0].mean())

        random = quality.Model(centre, scale, rng.normal(size=(4, quality.HIDDEN)), np.zeros(quality.HIDDEN), rng.normal(size=quality.HIDDEN), 0.0, prior)
        assert risk(quality.fit(good, free, prior)) < risk(random)
