"""Incident state of health checks."""

from __future__ import annotations

import bisect
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from werkbank.operators.ordered import running_last

# The state function travels with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Runs of a service that stay open, i.e. may still get checks or runs before them.
OPEN_RUNS = 10_000
ALERT_CHANGES = ("service string, run_id long, kind string, alert string, change int, healthy boolean, mail_accepted boolean")
#: Services are dealt over this many groups, as each group that a batch touches costs some milliseconds.
SERVICE_GROUPS = 4_096
GROUP_STATE = "services string"


def reduced_runs(checks: DataFrame) -> DataFrame:
    """One row per run of a service: healthy, or its mail accepted, only if all its checks say so. Rows of
    parts of the checks, reduced again, give the same, in whatever order they came."""
    return checks.groupBy("service", "run_id").agg(
        F.bool_and("healthy").alias("healthy"), F.bool_and("mail_accepted").alias("mail_accepted"))


def incident_states(checks: DataFrame, pieces: int | None = None) -> DataFrame:
    """Alert of each run of a service: ``problem`` whenever a check fails, ``recovered`` once
    after a problem whose mail was accepted.

    Checks ``(service, run_id, healthy, mail_accepted)`` are reduced to one row per run. What
    is known of an incident changes only when a mail is accepted, so the state before a run is
    the outcome of the latest earlier run with an accepted mail.
    """
    runs = reduced_runs(checks).select("service", "run_id", (~F.col("healthy")).alias("failing"), "mail_accepted")
    runs = runs.withColumn("_told", F.when(F.col("mail_accepted"), F.col("failing"))).drop("mail_accepted")
    told = running_last(runs, ["service"], "run_id", F.col("_told"), before=True, pieces=pieces)
    notified = F.coalesce("last_mark", F.lit(False))
    return told.select("service", "run_id", "failing", notified.alias("notified_before"),
                       F.when(F.col("failing"), "problem").when(notified, "recovered").alias("alert"),
                       F.coalesce("_told", notified).alias("notified"))


def _both(a: bool | None, b: bool | None) -> bool | None:
    """True only if all that is known is."""
    return b if a is None else a if b is None else a and b


class OpenRuns:
    """The runs of a service that are still open, and what was notified before them.

    ``runs`` maps a run to whether it is healthy, whether its mail was accepted, and the alert that was raised for it. Runs
    up to ``closed`` are settled: only their outcome, ``notified``, is kept."""

    def __init__(self, runs: dict[int, list], notified: bool, closed: int | None):
        self.runs, self.notified, self.closed = runs, notified, closed
        self.order = sorted(runs)

    @classmethod
    def loaded(cls, state: tuple | None) -> OpenRuns:
        if state is None:
            return cls({}, False, None)
        runs, notified, closed = state
        return cls({r: rest for r, *rest in json.loads(runs)}, notified, closed)

    def state(self) -> tuple:
        return json.dumps([[r, *self.runs[r]] for r in self.order]), self.notified, self.closed

    def add(self, run: int, healthy: bool | None, accepted: bool | None) -> bool:
        """Take a check in; False if its run is settled."""
        if self.closed is not None and run <= self.closed:
            return False
        known = self.runs.get(run)
        if known is None:
            self.runs[run] = [healthy, accepted, None]
            bisect.insort(self.order, run)
        else:
            known[:2] = _both(known[0], healthy), _both(known[1], accepted)
        return True

    def changes(self) -> Iterator[tuple[int, str, int]]:
        """What the alerts of the open runs are now against what was raised: run, alert, and 1 for an alert that is
        raised, -1 for one that is taken back."""
        notified = self.notified
        for run in self.order:
            healthy, accepted, raised = self.runs[run]
            alert = "problem" if healthy is False else "recovered" if notified else None
            if alert != raised:
                if raised:
                    yield run, raised, -1
                if alert:
                    yield run, alert, 1
                self.runs[run][2] = alert
            if accepted and healthy is not None:
                notified = not healthy

    def settle(self, most: int) -> None:
        """Close the oldest runs beyond ``most``."""
        over, self.order = self.order[:max(0, len(self.order) - most)], self.order[max(0, len(self.order) - most):]
        for run in over:
            healthy, accepted, _ = self.runs.pop(run)
            if accepted and healthy is not None:
                self.notified = not healthy
            self.closed = run


def alert_changes(checks: DataFrame, open_runs: int = OPEN_RUNS) -> DataFrame:
    """Alerts of a stream of checks as they happen (``ALERT_CHANGES``): rows of kind ``alert`` raise an alert (change 1) or
    take it back (-1), so that the sum of the changes is what ``incident_states`` gives for the checks so far,
    in whatever order and parts they come. A run that comes late, or a check that comes late for its run, corrects the alert
    of the run and of those behind it.

    The state of a service is the outcome of its settled runs and at most ``open_runs`` open ones; older runs are
    settled at the end of each batch. A check of a settled run changes nothing and goes out as a row of kind ``late`` with the
    check, so that none is lost. Checks are reduced to one row per run in their task before they meet the state;
    those without a run are late at once. Services share ``SERVICE_GROUPS`` groups of state, so that very many services are no
    more groups; within a group each has a state of its own."""
    columns = [c.split()[0] for c in ALERT_CHANGES.split(", ")]

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            runs: dict[tuple, list] = {}
            for service, run, healthy, accepted in zip(*(frame[c].tolist() for c in frame.columns)):
                key = (None if pd.isna(service) else service, None if pd.isna(run) else int(run))
                known = runs.setdefault(key, [None, None])
                known[:] = _both(known[0], None if pd.isna(healthy) else healthy), _both(known[1], None if pd.isna(accepted) else accepted)
            yield pd.DataFrame([(*k, *v) for k, v in runs.items()], columns=list(frame.columns)).astype(
                {"run_id": "Int64", "healthy": "boolean", "mail_accepted": "boolean"})

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        came: dict[str | None, list] = {}
        for frame in frames:
            for service, *check in zip(*(frame[c].tolist() for c in ("service", "run_id", "healthy", "mail_accepted"))):
                came.setdefault(None if pd.isna(service) else service, []).append([None if pd.isna(x) else x for x in check])
        # One service after the other is opened; those without checks in this batch stay as they are.
        kept = {service: rest for service, *rest in json.loads(state.get[0])} if state.exists else {}
        out = []
        for service, rows in came.items():
            known = OpenRuns.loaded(kept.get(service))
            for run, healthy, accepted in rows:
                if run is None or not known.add(run, healthy, accepted):
                    out.append((service, run, "late", None, 0, healthy, accepted))
            out += [(service, run, "alert", alert, change, None, None) for run, alert, change in known.changes()]
            known.settle(open_runs)
            kept[service] = known.state()
        state.update((json.dumps([(service, *rest) for service, rest in kept.items()]),))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"run_id": "Int64", "healthy": "boolean", "mail_accepted": "boolean"})

    rows = checks.select(F.col("service").cast("string").alias("service"), F.col("run_id").cast("long").alias("run_id"), "healthy", "mail_accepted")
    group = F.pmod(F.xxhash64("service"), F.lit(SERVICE_GROUPS)).cast("int")
    return rows.mapInPandas(reduced, rows.schema).withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        run, ALERT_CHANGES, GROUP_STATE, "append", "NoTimeout")


def standing_alerts(changes: DataFrame) -> DataFrame:
    """The alerts that stand after all changes: one row per run with an alert."""
    return (changes.filter("kind = 'alert'").groupBy("service", "run_id", "alert").agg(F.sum("change").alias("_n"))
            .filter(F.col("_n") > 0).drop("_n"))
