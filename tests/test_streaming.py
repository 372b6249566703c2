import random
from datetime import datetime, timedelta

import pytest
from helpers import values
from pyspark.sql import functions as F
from test_traffic import expected_alerts

from werkbank.plans import traffic
from werkbank.streaming import jobs
from werkbank.streaming.sinks import compact, read_latest

START = datetime(2024, 1, 1)


def feed(spark, folder, rows, schema, step):
    """Write each step as its own file and return a stream that reads one file per trigger."""
    for part in range(0, len(rows), step):
        spark.createDataFrame(rows[part:part + step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(job, folder, *args, **kwargs):
    job(*args, f"{folder}/out", f"{folder}/checkpoint", **kwargs).awaitTermination()
    return f"{folder}/out"


def test_messages_redelivered_and_edited(spark, tmp_path):
    schema = "message_id string, ticket_id string, direction string, body string, position int, cached_at timestamp"
    row = lambda i, body, minutes: (i, "T", "Incoming", body, 0, START + timedelta(minutes=minutes))
    folder = str(tmp_path)
    raw = feed(spark, folder, [row("1", "a", 0), row("2", "b", 1), row("1", "a", 0), row("3", "c", 500), row("1", "new", 600)],
               schema, 1)
    path = run(jobs.stream_messages, folder, raw)
    assert values(read_latest(spark, path, ["message_id"], ["cached_at"]), "message_id", "body", sort=True) == [
        ("1", "new"), ("2", "b"), ("3", "c")]
    # a restart with nothing new changes nothing
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run(jobs.stream_messages, folder, again)
    assert spark.read.parquet(path).count() == 5
    compact(spark, path, f"{folder}/small", ["message_id"], ["cached_at"])
    assert values(read_latest(spark, f"{folder}/small", ["message_id"], ["cached_at"]), "body", sort=True) == ["b", "c", "new"]


def test_counts_by_monday_week(spark, tmp_path):
    rows = [(START + timedelta(days=d),) for d in (0, 6, 7, 400, 8, 1, 13, 14)]
    source = feed(spark, str(tmp_path), rows, "ts timestamp", 3)
    path = run(jobs.stream_counts, str(tmp_path), source, grain="week")
    got = values(read_latest(spark, path, ["period"]).select(F.col("period").cast("string"), "n"), "period", "n", sort=True)
    assert got == [("2024-01-01", 3), ("2024-01-08", 3), ("2024-01-15", 1), ("2025-02-03", 1)]


def test_sessions_with_late_events(spark, tmp_path):
    minutes = [(1, 0), (1, 55), (2, 5), (1, 90), (3, 300), (1, 30), (1, 125), (1, 31), (2, 36)]
    rows = [(i, START + timedelta(minutes=m), u, "view", 1.0) for i, (u, m) in enumerate(minutes)]
    source = feed(spark, str(tmp_path), rows, "event_id long, ts timestamp, user_id long, event_type string, value double", 2)
    path = run(jobs.stream_sessions, str(tmp_path), source)
    assert values(jobs.read_sessions(spark, path), "user_id", "events", sort=True) == [
        (1, 1), (1, 1), (1, 4), (2, 1), (2, 1), (3, 1)]


def test_sessions_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, START + timedelta(seconds=rng.randrange(3 * 86_400)), rng.randrange(4), rng.choice(["view", "purchase", "click"]), 1.0)
            for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    want = sorted(map(tuple, traffic.sessions(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    path = run(jobs.stream_sessions, str(tmp_path), feed(spark, str(tmp_path), rows, schema, 67))
    assert sorted(map(tuple, jobs.read_sessions(spark, path).collect())) == want


def test_incidents_in_any_order_of_arrival(spark, tmp_path):
    """Runs come late and out of order, and the checks of a run in several batches."""
    runs = [(True, False), (True, True), (False, False), (False, True), (False, True), (True, True), (False, True)]
    schema = "service long, run_id long, healthy boolean, mail_accepted boolean"
    rows = [(7, i, part or not f, a) for i, (f, a) in enumerate(runs) for part in (False, True)] + [(8, 0, True, True)]
    random.Random(1).shuffle(rows)
    source = feed(spark, str(tmp_path), rows, schema, 2)
    path = run(jobs.stream_incidents, str(tmp_path), source)
    got = jobs.read_incidents(spark, path).orderBy("run_id")
    assert values(got.filter("service = 7"), "alert") == expected_alerts(runs)
    assert values(got.filter("service = 8"), "alert") == [None]


def test_a_late_run_counts(spark, tmp_path):
    schema = "service long, run_id long, healthy boolean, mail_accepted boolean"
    rows = [(1, 1, False, True), (1, 5, True, True), (1, 3, True, True)]
    path = run(jobs.stream_incidents, str(tmp_path), feed(spark, str(tmp_path), rows, schema, 2))
    got = jobs.read_incidents(spark, path).orderBy("run_id")
    assert values(got, "run_id", "alert", "notified_before") == [(1, "problem", False), (3, "recovered", True), (5, None, False)]


def checks_of(rng, services, runs):
    """Checks (service, run_id, healthy, mail_accepted), several per run, with missing values."""
    return [(s, r, rng.random() < 0.8, rng.choice([True, True, False, None])) for s in services for r in range(runs) for _ in range(rng.randrange(1, 3))]


CHECKS = "service string, run_id long, healthy boolean, mail_accepted boolean"


def batch_alerts(spark, rows):
    from werkbank.plans.monitoring import incident_states

    found = incident_states(spark.createDataFrame(rows, CHECKS)).filter("alert IS NOT NULL")
    return sorted(map(tuple, found.select("service", "run_id", "alert").collect()), key=repr)


def standing(spark, path):
    return sorted(map(tuple, jobs.read_alerts(spark, path).select("service", "run_id", "alert").collect()), key=repr)


def test_alerts_net_to_the_batch(spark, tmp_path):
    """Shuffled, split and late: what stands after all changes is the batch's result, and nothing is late."""
    rng = random.Random(9)
    rows = checks_of(rng, ["a", "b", None], 40)
    rng.shuffle(rows)
    path = run(jobs.stream_alerts, str(tmp_path), feed(spark, str(tmp_path), rows, CHECKS, 30))
    changes = spark.read.parquet(path)
    assert standing(spark, path) == batch_alerts(spark, rows)
    assert changes.filter("kind = 'late'").count() == 0 and changes.filter("change = -1").count() > 0


def test_alerts_come_in_their_batch_and_are_corrected(spark, tmp_path):
    rows = [("s", 1, False, True), ("s", 3, True, True), ("s", 2, True, True)]
    path = run(jobs.stream_alerts, str(tmp_path), feed(spark, str(tmp_path), rows, CHECKS, 1))
    got = [sorted(map(tuple, spark.read.parquet(f"{path}/batch_id={b}").select("run_id", "alert", "change").collect())) for b in range(3)]
    # The late run 2 recovers the service, so that the alert of run 3 is taken back.
    assert got == [[(1, "problem", 1)], [(3, "recovered", 1)], [(2, "recovered", 1), (3, "recovered", -1)]]


def test_alert_state_is_bounded_and_late_checks_are_kept(spark, tmp_path):
    rng = random.Random(4)
    rows = [("s", r, rng.random() < 0.5, True) for r in range(60)] + [("s", 3, False, True), ("s", None, True, True)]
    query_rows = feed(spark, str(tmp_path), rows, CHECKS, 10)
    path = run(jobs.stream_alerts, str(tmp_path), query_rows, open_runs=15)
    late = spark.read.parquet(path).filter("kind = 'late'")
    assert values(late, "run_id", "healthy", sort=True) == sorted([(3, False), (None, True)], key=repr)
    assert standing(spark, path) == batch_alerts(spark, [r for r in rows[:60]])


def test_settled_runs_keep_their_outcome():
    from werkbank.plans.monitoring import OpenRuns

    known = OpenRuns.loaded(None)
    for run_ in range(100):
        assert known.add(run_, run_ % 10 != 7, True)
    first = list(known.changes())
    known.settle(5)
    again = OpenRuns.loaded(known.state())
    assert len(again.runs) == 5 and again.closed == 94 and again.notified is False
    assert list(again.changes()) == [] and not again.add(94, True, True) and first[0] == (7, "problem", 1)


def bounded(spark, folder, rows, step, delay):
    path = run(jobs.stream_bounded_counts, folder, feed(spark, folder, rows, "ts timestamp", step), delay=delay)
    frame = jobs.read_bounded_counts(spark, path).withColumn("period", F.col("period").cast("string"))
    return path, {r["period"]: (r["n"], r["rejected"], r["closed"]) for r in frame.collect()}


def test_counts_and_rejects_make_all_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(START + timedelta(hours=rng.randrange(24 * 12)),) for _ in range(120)] + [(None,)] * 3
    rng.shuffle(rows)
    want = {}
    for (at,) in rows:
        day = at and at.strftime("%Y-%m-%d")
        want[day] = want.get(day, 0) + 1
    for i, delay in enumerate(("1 hour", "3 days", "30 days")):
        _, got = bounded(spark, str(tmp_path / str(i)), rows, 20, delay)
        assert {d: n + late for d, (n, late, _) in got.items()} == want
        assert (sum(late for _, late, _ in got.values()) == 0) == (delay == "30 days")


def test_a_period_closes_and_its_late_rows_are_rejected(spark, tmp_path):
    day = lambda d, h=1: (START + timedelta(days=d, hours=h),)
    rows = [day(0), day(0), day(1), day(5), day(5, 2), day(0, 3), day(5, 4), day(1, 9)]
    path, got = bounded(spark, str(tmp_path), rows, 2, "1 day")
    assert got["2024-01-01"] == (2, 1, True) and got["2024-01-02"] == (1, 1, True) and got["2024-01-06"] == (3, 0, False)
    states = [r["kind"] for r in spark.read.parquet(path).filter("period = '2024-01-01'").orderBy("batch_id").collect()]
    assert states == ["open", "closed", "late"]


def test_state_of_closed_periods_goes(spark, tmp_path):
    rows = [(START + timedelta(days=d),) for d in range(40) for _ in range(2)]
    source = feed(spark, str(tmp_path), rows, "ts timestamp", 8)
    query = jobs.stream_bounded_counts(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", delay="2 days")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and max(held) <= 12


@pytest.mark.parametrize("name", ["stream_messages", "stream_messages_compacted"])
def test_streams_read_a_table_of_one_file_or_of_many(spark, tmp_path, name):
    from werkbank.registry import QUERIES

    rows = spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c in range(20) for t in range(3)] + [(None, None, None, None)],
                                 "conv_id bigint, turn bigint, role string, text string").repartition(4)
    rows.write.parquet(f"{tmp_path}/many/conversations.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/landed")
    (tmp_path / "one").mkdir()
    next((tmp_path / "landed").glob("*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    one, many = (sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{folder}").collect()), key=repr) for folder in ("one", "many"))
    assert len(one) == 61 and one == many


def test_alerts_of_services_that_share_a_group(spark, tmp_path, monkeypatch):
    """Sixty services (and one without a name) in seven groups: few groups of state, and each service has its own alerts."""
    from werkbank.plans import monitoring

    monkeypatch.setattr(monitoring, "SERVICE_GROUPS", 7)
    rng = random.Random(3)
    rows = checks_of(rng, [f'"s{i}' for i in range(60)] + [None], 6)
    rng.shuffle(rows)
    feed(spark, str(tmp_path), rows, CHECKS, len(rows) // 3 + 1)
    checks = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.stream_alerts(checks, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert standing(spark, f"{tmp_path}/out") == batch_alerts(spark, rows)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 7
    assert spark.read.parquet(f"{tmp_path}/out").filter("kind = 'late'").count() == 0
