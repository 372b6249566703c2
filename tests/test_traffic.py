import random
from datetime import date, datetime, timedelta

import pytest
from helpers import values

from werkbank.plans import monitoring, similar, traffic


def events(spark, rows):
    full = [(i, datetime(2024, 1, 1) + timedelta(seconds=s), u, k, v) for i, (s, u, k, v) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, ts timestamp, user_id long, event_type string, value double")


def brute_sessions(rows):
    out = []
    for user in {u for _, u, _, _ in rows}:
        last = None
        for s in sorted(s for s, u, _, _ in rows if u == user):
            if last is None or s - last > 1800:
                out.append([user, 0])
            out[-1][1] += 1
            last = s
    return sorted(map(tuple, out))


def test_sessions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200_000), 1 if rng.random() < 0.3 else rng.randrange(2, 40), "view", 1.0) for _ in range(1500)]
    rows += [(0, 99, "view", 1.0), (1800, 99, "view", 1.0), (3601, 99, "view", 1.0)]
    got = traffic.sessions(events(spark, rows))
    assert sorted(values(got, "user_id", "events")) == brute_sessions(rows)


def test_report(spark):
    day = 86400
    frame = events(spark, [(0, 1, "view", 9.0), (5, 1, "view", 9.0), (day, 1, "purchase", 2.5), (day, 2, "click", 7.0),
                           (2 * day, 3, "click", 1.0)])
    total = traffic.traffic_report(frame, list(traffic.METRICS), "overview", "2024-01-01", "2024-01-02").collect()[0]
    assert tuple(total) == (2, 3, 2, 2 / 3, 1, 2.5)
    dates = traffic.traffic_report(frame, ["activeUsers", "sessions"], "date", "2024-01-01", "2024-01-02")
    assert values(dates, "date", "activeUsers", "sessions", sort=True) == [(date(2024, 1, 1), 1, 1), (date(2024, 1, 2), 2, 2)]
    page = traffic.website_traffic(frame, "sessions", "date", "2daysAgo", "yesterday", date(2024, 1, 3), limit=1)
    assert [tuple(r) for r in page.collect()] == [(date(2024, 1, 1), 1, 2, 1)]
    assert traffic.traffic_report(frame, ["activeUsers"], "date", "2030-01-01", "2030-01-01").count() == 0


@pytest.mark.parametrize("arguments", [
    dict(metrics=["sessions", "sessions"]), dict(metrics=[]), dict(metrics=["clicks"]),
    dict(metrics=["sessions"], start_date="2024-01-02", end_date="2024-01-01"),
    dict(metrics=["sessions"], start_date="2024-1-1", end_date="2024-01-02")])
def test_report_arguments(spark, arguments):
    with pytest.raises(ValueError):
        traffic.traffic_report(events(spark, [(0, 1, "view", 1.0)]), **{"end_date": "2024-01-03", "start_date": "2024-01-01", **arguments})


def expected_alerts(runs):
    notified, out = False, []
    for failing, accepted in runs:
        alert = "problem" if failing else "recovered" if notified else None
        out.append(alert)
        if alert and accepted:
            notified = failing
    return out


@pytest.mark.parametrize("pieces", [1, 16])
def test_incidents(spark, pieces):
    rng = random.Random(5)
    runs = [(rng.random() < 0.4, rng.random() < 0.7) for _ in range(300)]
    checks = [("s", i, not failing if j == 0 else True, accepted) for i, (failing, accepted) in enumerate(runs) for j in (0, 1)]
    frame = spark.createDataFrame(checks, "service string, run_id long, healthy boolean, mail_accepted boolean")
    got = monitoring.incident_states(frame, pieces).orderBy("run_id")
    assert values(got, "alert") == expected_alerts(runs)


def nearest(queries, chunks, k):
    out = []
    for q, own, sku, status, vector in queries:
        size = lambda v: sum(x * x for x in v) ** 0.5
        scored = [(-sum(a * b for a, b in zip(vector, v)) / (size(vector) * size(v)), c, t) for c, t, s, st, v in chunks
                  if sku in (None, s) and status in (None, st)]
        out += [(q, rank + 1, t) for rank, (_, _, t) in enumerate(sorted(scored)[:k]) if t != own]
    return sorted(out)


@pytest.mark.parametrize("limits", [dict(), dict(cells=5, blocks=4), dict(cells=1)])
def test_precedents_equal_brute_force(spark, limits):
    rng = random.Random(11)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    chunks = [(i, f"T{i // 2}", rng.choice(["a", "b", None]), rng.choice(["open", "done"]), vector()) for i in range(150)]
    queries = [(str(i), f"T{rng.randrange(75)}", rng.choice([None, "a"]), rng.choice([None, "open"]), vector()) for i in range(14)]
    queries += [("own", "T3", None, None, chunks[7][4]), ("none", "T1", "zzz", None, vector())]
    left = spark.createDataFrame(queries, "query_id string, ticket_id string, product_sku string, status string, vector array<double>")
    right = spark.createDataFrame(chunks, "chunk_id long, ticket_id string, product_sku string, status string, vector array<double>")
    got = similar.precedents(left, right, 5, **limits)
    assert sorted(values(got, "query_id", "rank", "ticket_id")) == nearest(queries, chunks, 5)
    assert not [r for r in got.collect() if r["query_id"] == "own" and r["ticket_id"] == "T3"]
