"""Golden cases of the event log: rows in, one expected result out."""

import pytest

from runlode.operators import journal
from runlode.streaming.status import fold_statuses

SCHEMA = "search_id string, seq long, ts_ms long, event string, task string, worker long, attempt int, device string, host string, driver string, record string, reason string, tasks long, restored long, stats array<struct<name:string,value:double>>"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def log(spark, *events, search="s"):
    rows = []
    for seq, (ts, event, more) in enumerate(events):
        row = dict.fromkeys(FIELDS) | {"search_id": search, "seq": seq, "ts_ms": ts, "event": event} | more
        rows.append(tuple(row[f] for f in FIELDS))
    return spark.createDataFrame(rows, SCHEMA)


def started(ts, tasks=2, restored=0):
    return ts, "search_started", {"tasks": tasks, "restored": restored}


def leased(ts, task, worker=0, attempt=0):
    return ts, "leased", {"task": task, "worker": worker, "attempt": attempt}


def bound(ts, worker=0, device="d", host=""):
    return ts, "worker_bound", {"worker": worker, "device": device, "host": host}


def ev(ts, event, task, **more):
    return ts, event, {"task": task} | more


def committed(ts, task, value=0.0):
    return ts, "committed", {"task": task, "stats": [("attempt", value)], "record": "r"}


def test_throughput(spark):
    j = log(spark, started(1000), leased(1100, "aa"), committed(2100, "aa"), leased(2100, "bb"), committed(5000, "bb"))
    r = journal.session_bounds(j).first()
    assert (r.start_ms, r.end_ms, r.tasks, r.session_committed, r.committed) == (1000, 5000, 2, 2, 2)


def test_busy_time_and_open_lease(spark):
    j = log(spark, started(0), leased(100, "aa"), committed(400, "aa"), leased(1000, "bb"), committed(1500, "bb"))
    assert journal.worker_metrics(j).first().busy_ms == 800
    j = log(spark, started(0), leased(100, "aa"), bound(900, 1))
    spans = journal.lease_spans(j).collect()
    assert [(s.start_ms, s.end_ms) for s in spans] == [(100, 900)]


def test_session_scope(spark):
    j = log(spark, started(0), leased(1, "aa"), committed(2, "aa"), started(10), leased(11, "bb"), committed(12, "bb"))
    r = journal.session_bounds(j).first()
    assert (r.start_ms, r.session_committed, r.committed) == (10, 1, 2)


def test_no_start_reads_the_whole_log(spark):
    j = log(spark, leased(5, "aa"), committed(9, "aa"))
    assert journal.session_bounds(j).first().start_ms == 5


def test_retry_figures(spark):
    events = [started(0, 12)]
    for i in range(12):
        for k in range(3 if i < 4 else 0):
            events += [leased(1, f"t{i}", 0, k), ev(1, "failed", f"t{i}"), ev(1, "retried", f"t{i}")]
        events += [leased(1, f"t{i}"), committed(2, f"t{i}")]
    r = journal.session_retries(log(spark, *events)).first()
    assert (r.retries, r.retried_tasks, r.failed_attempts, r.total_attempts) == (12, 4, 12, 24)


def test_attempts(spark):
    j = log(spark, leased(1, "aa", 0, 0), ev(2, "failed", "aa", reason="x"), ev(3, "retried", "aa"), leased(4, "aa", 0, 1), committed(5, "aa"))
    got = {r.number: (r.attempt, r.started_ms, r.ended_ms, r.result) for r in journal.task_attempts(j).collect()}
    assert got == {1: (0, 1, 2, "failed"), 2: (1, 4, 5, "committed")}


def test_only_the_last_attempt_closes_and_once(spark):
    j = log(spark, leased(10, "aa"), committed(20, "aa"), committed(90, "aa"))
    r = journal.task_attempts(j).collect()
    assert [(x.ended_ms, x.result) for x in r] == [(20, "committed")]
    j = log(spark, leased(1, "aa"), leased(2, "aa"), committed(3, "aa"))
    assert {x.number: x.result for x in journal.task_attempts(j).collect()} == {1: "in_flight", 2: "committed"}


def test_lease_expiry_marks_the_open_attempt(spark):
    j = log(spark, leased(1, "aa"), ev(2, "lease_expired", "aa"), ev(3, "failed", "aa"), ev(4, "lease_expired", "aa"), leased(5, "aa"), committed(6, "aa"))
    assert {x.number: x.lease_expired for x in journal.task_attempts(j).collect()} == {1: True, 2: False}


def test_outcome_without_lease(spark):
    j = log(spark, ev(1, "queued", "aa"), ev(2, "queued", "aa"), ev(3, "rejected", "aa", reason="x"))
    r = journal.task_outcomes(j).first()
    assert (r.queued_ms, r.outcome) == (1, "rejected")
    assert [x.task for x in journal.failed_tasks(j).collect()] == ["aa"]
    assert journal.task_attempts(j).count() == 0


def test_failed_attempt_leaves_the_task_open(spark):
    j = log(spark, leased(1, "aa"), ev(2, "failed", "aa"))
    assert journal.task_outcomes(j).first().outcome == "in_progress"


def test_prefixes(spark):
    j = log(spark, leased(1, "aabb"), leased(1, "aacc"), leased(1, "dd"))
    asked = spark.createDataFrame([("s", "d"), ("s", "aa"), ("s", "zz")], "search_id string, prefix string")
    got = {r.prefix: (r.resolution, r.task) for r in journal.prefix_resolution(j, asked).collect()}
    assert got == {"d": ("found", "dd"), "aa": ("ambiguous: 2", None), "zz": ("no task", None)}


def test_spawn_latency(spark):
    j = log(spark, started(1000), bound(1000, 0), bound(42200, 1), committed(50000, "aa"))
    w = {r.worker: r for r in journal.worker_metrics(j).collect()}
    assert (w[1].first_bind_ms, w[1].lifespan_ms) == (42200, 7800)


def test_late_binding_shows_the_last_device(spark):
    j = log(spark, leased(10, "aa"), bound(15, 0, "gpu"), committed(20, "aa"))
    assert journal.task_attempts(j).first().device == "gpu"


@pytest.mark.parametrize(
    ("events", "expected"),
    [
        ([bound(0, 0, "A"), leased(1, "aa"), committed(2, "aa"), bound(3, 0, "B"), leased(4, "bb"), committed(5, "bb")], {"A": 1, "B": 1}),
        ([bound(0, 0, "A", "h1"), bound(0, 1, "A", "h2"), leased(1, "aa", 0), leased(1, "bb", 1), committed(2, "aa"), committed(3, "bb")], {"A @ h1": 1, "A @ h2": 1}),
        ([bound(0), leased(1, "aa"), started(2), committed(3, "aa")], {}),
        ([bound(0), leased(1, "aa"), leased(2, "bb"), committed(3, "aa"), committed(4, "bb")], {"d": 1}),
        ([bound(0), leased(1, "aa"), committed(2, "aa"), committed(3, "aa")], {"d": 1}),
        ([bound(0, 0, ""), leased(1, "aa"), committed(2, "aa")], {}),
    ],
)
def test_composition_window_form_is_the_fold(spark, events, expected):
    import json

    j = log(spark, *events)
    assert {r.label: r.commits for r in journal.status_composition(j).collect()} == expected
    assert json.loads(fold_statuses(j).first().devices) == expected


def test_resume_restates_tasks_and_empties_occupancy(spark):
    j = log(spark, started(0, 5), leased(1, "aa", 3), started(2, 7))
    assert journal.status_counts(j).first().tasks == 7
    assert journal.status_occupancy(j).count() == 0
    j = log(spark, started(0, 5), leased(1, "aa", 3))
    assert [(r.worker, r.task) for r in journal.status_occupancy(j).collect()] == [(3, "aa")]


@pytest.mark.parametrize(("event", "state"), [("search_finalized", "finalized"), ("search_failed", "failed"), ("search_interrupted", "interrupted"), ("leased", "in_progress")])
def test_state(spark, event, state):
    j = log(spark, started(0), (1, event, {"task": "aa", "reason": "x", "worker": 0}))
    r = journal.status_counts(j).first()
    assert r.state == state
    assert r.failed_task == ("aa" if state == "failed" else None)


def test_backward_stamps_make_empty_spans(spark):
    j = log(spark, started(1000), leased(900, "aa"), committed(100, "aa"))
    s = journal.lease_spans(j).first()
    assert s.start_ms == s.end_ms == 900
    assert journal.worker_metrics(j).first().lifespan_ms == 0


def test_latest_stats_and_histogram_order(spark):
    j = log(spark, committed(1, "bb", 1.0), committed(2, "aa", 0.0), committed(3, "aa", 1.0), committed(4, "cc", 0.0))
    assert {r.task: r.stats[0].value for r in journal.latest_stats(j).collect()} == {"aa": 1.0, "bb": 1.0, "cc": 0.0}
    assert [(r.stats[0].value, r.tasks) for r in journal.stats_histogram(j).collect()] == [(1.0, 2), (0.0, 1)]


def test_running_commits_are_anchored(spark):
    j = log(spark, started(0, 9, 4), committed(1, "aa"), started(2, 9, 5), committed(3, "bb"), committed(4, "cc"))
    for block in (1, 2, 3, 100):
        assert [(r.seq, r.done, r.tasks) for r in journal.running_commits(j, block).orderBy("seq").collect()] == [(1, 5, 9), (3, 6, 9), (4, 7, 9)]
    j = log(spark, committed(0, "aa"), committed(1, "bb"), started(2, 9, 1), committed(3, "bb"))
    for block in (1, 2, 3, 100):
        assert [(r.done, r.tasks) for r in journal.running_commits(j, block).orderBy("seq").collect()] == [(1, 0), (2, 0), (2, 9)]


def test_driver_changes(spark):
    j = log(spark, bound(0)[:2] + ({"worker": 0, "device": "d", "host": "", "driver": "1"},), bound(1)[:2] + ({"worker": 0, "device": "d", "host": "", "driver": "2"},))
    assert [(r.seq, r.from_driver, r.to_driver) for r in journal.driver_changes(j).collect()] == [(1, "1", "2")]
    base = spark.createDataFrame([("s", "", "d", "0")], "search_id string, host string, device string, driver string")
    assert journal.driver_changes(j, base).count() == 2


def test_chart(spark):
    j = log(spark, started(0), bound(0), leased(0, "aa"), committed(480, "aa"), leased(480, "bb"), committed(4800, "bb"))
    spark_line = {r.column: (r.commits, r.level) for r in journal.commit_sparkline(j).collect()}
    assert len(spark_line) == 48 and spark_line[4] == (1, 8) and spark_line[47] == (1, 8)
    cells = {r.column: r.glyph for r in journal.occupancy_buckets(j).collect()}
    assert len(cells) == 48 and cells[0] == "full"


def test_empty_log(spark):
    j = spark.createDataFrame([], SCHEMA)
    for f in (journal.status_counts, journal.status_composition, journal.task_attempts, journal.session_bounds, journal.worker_metrics, journal.commit_sparkline, fold_statuses):
        assert f(j).count() == 0
