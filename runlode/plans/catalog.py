"""The registered queries: operators over the logical tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlode.functions import scalars as fn
from runlode.operators import generate, journal, ledger, objects, placement, simulate, store
from runlode.plans import render
from runlode.plans import views as v
from runlode.streaming import feed, supervise
from runlode.streaming import status as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, *ctes: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = ("WITH " + ",".join(ctes) + " " if ctes else "") + oracle
        return f

    return add


# ---- the event log

_LAST_SESSION = """
ss AS (SELECT search_id, coalesce(max(seq) FILTER (event = 'search_started'), min(seq)) AS s0 FROM journal GROUP BY 1),
session AS (SELECT j.* FROM journal j JOIN ss ON j.search_id = ss.search_id AND j.seq >= ss.s0),
bounds AS (SELECT search_id, arg_min(ts_ms, seq) AS start_ms, arg_max(ts_ms, seq) AS end_ms FROM session GROUP BY 1),
binds AS (SELECT search_id, worker, arg_max(device, seq) AS device, arg_max(host, seq) AS host FROM journal WHERE event = 'worker_bound' GROUP BY 1, 2)"""
_SPANS = (
    _LAST_SESSION
    + """,
led AS (SELECT search_id, worker, seq, event, ts_ms, lead(event) OVER w AS ne, lead(ts_ms) OVER w AS nt FROM session WHERE event IN ('leased', 'committed', 'failed', 'rejected', 'faulted') WINDOW w AS (PARTITION BY search_id, task ORDER BY seq)),
spans AS (SELECT l.search_id, l.worker, l.ts_ms AS start_ms, greatest(l.ts_ms, coalesce(l.nt, b.end_ms)) AS end_ms, coalesce(l.ne = 'committed', false) AS done FROM led l JOIN bounds b USING (search_id) WHERE l.event = 'leased' AND (l.ne IS NULL OR l.ne <> 'leased'))"""
)
_METRICS = (
    _SPANS
    + """,
seen AS (SELECT search_id, worker, min(ts_ms) FILTER (event = 'worker_bound') AS bind, count(*) FILTER (event = 'worker_bound') AS nb, count(*) FILTER (event = 'leased') AS attempts FROM session WHERE event IN ('worker_bound', 'leased') GROUP BY 1, 2),
sums AS (SELECT search_id, worker, sum(end_ms - start_ms) AS busy, count(*) FILTER (done) AS commits FROM spans GROUP BY 1, 2),
metrics AS (SELECT s.search_id, s.worker, coalesce(device, '') AS device, coalesce(host, '') AS host, coalesce(bind, b.start_ms) AS first_bind_ms, greatest(0, nb - 1) AS respawns, CAST(coalesce(busy, 0) AS BIGINT) AS busy_ms,
  greatest(0, b.end_ms - coalesce(bind, b.start_ms)) AS lifespan_ms, coalesce(commits, 0) AS commits, attempts
  FROM seen s JOIN bounds b USING (search_id) LEFT JOIN sums USING (search_id, worker) LEFT JOIN binds USING (search_id, worker))"""
)
_BUCKETS = """
buckets AS (SELECT search_id, c AS "column", start_ms + greatest(0, end_ms - start_ms) * c // 48 AS from_ms, start_ms + greatest(0, end_ms - start_ms) * (c + 1) // 48 AS to_ms FROM bounds, range(48) t(c))"""


_LEVEL = "('search_started', 'search_finalized', 'search_failed', 'search_interrupted')"
_LIFECYCLE = "('queued', 'leased', 'committed', 'failed', 'retried', 'rejected', 'faulted', 'lease_expired', 'checkpoint_degraded', 'checkpointed')"
_STATE = f"""
level AS (SELECT * FROM (SELECT search_id, event, task, reason, row_number() OVER (PARTITION BY search_id ORDER BY seq DESC) AS n FROM journal WHERE event IN {_LEVEL}) WHERE n = 1),
state AS (SELECT s.search_id, CASE event WHEN 'search_finalized' THEN 'finalized' WHEN 'search_failed' THEN 'failed' WHEN 'search_interrupted' THEN 'interrupted' ELSE 'in_progress' END AS state,
  CASE WHEN event = 'search_failed' THEN task END AS failed_task, CASE WHEN event = 'search_failed' THEN reason END AS failed_reason FROM (SELECT DISTINCT search_id FROM journal) s LEFT JOIN level USING (search_id))"""


@_query(
    f""", {_STATE}
SELECT search_id, CAST(coalesce(arg_max(tasks, seq) FILTER (event = 'search_started'), 0) AS BIGINT) AS tasks, count(*) FILTER (event = 'committed') AS committed, count(*) FILTER (event = 'retried') AS retried, count(*) FILTER (event = 'rejected') AS rejected,
  count(*) FILTER (event = 'faulted') AS faulted, count(*) FILTER (event = 'lease_expired') AS lease_expired, count(*) FILTER (event = 'checkpoint_degraded') AS checkpoint_degraded, count(*) FILTER (event = 'chain_rebound') AS rebound_chains,
  any_value(state.state) AS state, any_value(failed_task) AS failed_task, any_value(failed_reason) AS failed_reason FROM journal JOIN state USING (search_id) GROUP BY 1""",
    v.JOURNAL,
)
def status_counts(spark, d):
    return journal.status_counts(v.journal(spark, d))


@_query(
    f""", f AS (
  SELECT *, max(CASE WHEN event = 'leased' THEN seq END) OVER (PARTITION BY search_id, task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tl,
    arg_max(worker, CASE WHEN event = 'leased' THEN seq END) OVER (PARTITION BY search_id, task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wk,
    max(CASE WHEN event IN ('committed', 'failed', 'rejected', 'faulted') THEN seq END) OVER (PARTITION BY search_id, task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt,
    max(CASE WHEN event IN {_LEVEL} THEN seq END) OVER (PARTITION BY search_id ORDER BY seq) AS rs FROM journal
), g AS (
  SELECT f.search_id, f.seq, f.tl, f.lt, f.rs, (SELECT max(x.seq) FROM journal x WHERE x.event = 'leased' AND x.search_id = f.search_id AND x.worker = f.wk AND x.seq < f.seq) AS wl,
    (SELECT max(x.seq) FROM journal x WHERE x.event = 'worker_bound' AND x.search_id = f.search_id AND x.worker = f.wk AND x.seq < f.seq) AS wb FROM f WHERE event = 'committed' AND tl IS NOT NULL
)
SELECT g.search_id, CASE WHEN b.host = '' THEN b.device ELSE b.device || ' @ ' || b.host END AS label, count(*) AS commits FROM g JOIN journal b ON b.seq = g.wb AND b.search_id = g.search_id
WHERE g.wl = g.tl AND g.wl > coalesce(g.rs, -1) AND g.wl > coalesce(g.lt, -1) AND b.device <> '' GROUP BY 1, 2""",
    v.JOURNAL,
)
def status_composition(spark, d):
    return journal.status_composition(v.journal(spark, d))


@_query(
    f""", l AS (SELECT search_id, worker, max(seq) AS wl, arg_max(task, seq) AS task, arg_max(attempt, seq) AS attempt FROM journal WHERE event = 'leased' GROUP BY 1, 2),
t AS (SELECT search_id, task, max(seq) AS te FROM journal WHERE event IN ('committed', 'failed', 'rejected', 'faulted') GROUP BY 1, 2), r AS (SELECT search_id, max(seq) AS rs FROM journal WHERE event IN {_LEVEL} GROUP BY 1)
SELECT l.search_id, l.worker, l.task, l.attempt FROM l LEFT JOIN t USING (search_id, task) LEFT JOIN r USING (search_id) WHERE wl > coalesce(te, -1) AND wl > coalesce(rs, -1)""",
    v.JOURNAL,
)
def status_occupancy(spark, d):
    return journal.status_occupancy(v.journal(spark, d))


@_query()
def status_fold(spark, d):
    return live.fold_statuses(v.journal(spark, d))


@_query(
    f""", {_STATE}
SELECT search_id, max(seq) FILTER (event NOT IN ('queued', 'checkpointed', 'program_bound')) AS seq, CAST(coalesce(arg_max(tasks, seq) FILTER (event = 'search_started'), 0) AS BIGINT) AS tasks, count(*) FILTER (event = 'committed') AS committed, count(*) FILTER (event = 'retried') AS retried, count(*) FILTER (event = 'rejected') AS rejected,
  count(*) FILTER (event = 'faulted') AS faulted, count(*) FILTER (event = 'lease_expired') AS lease_expired, count(*) FILTER (event = 'checkpoint_degraded') AS checkpoint_degraded, count(*) FILTER (event = 'chain_rebound') AS rebound_chains, any_value(state.state) AS state FROM journal JOIN state USING (search_id) GROUP BY 1""",
    v.JOURNAL,
)
def status_fold_counters(spark, d):
    """The event-by-event fold, held against the aggregates."""
    return live.fold_statuses(v.journal(spark, d)).drop("devices", "occupancy")


@_query(
    """, n AS (SELECT *, count(*) FILTER (event = 'leased') OVER (PARTITION BY search_id, task ORDER BY seq) AS number FROM journal WHERE event IN ('leased', 'lease_expired', 'committed', 'failed', 'rejected', 'faulted')),
b AS (SELECT search_id, worker, arg_max(device, seq) AS device, arg_max(host, seq) AS host FROM journal WHERE event = 'worker_bound' GROUP BY 1, 2),
a AS (SELECT search_id, task, number, max(attempt) FILTER (event = 'leased') AS attempt, max(worker) FILTER (event = 'leased') AS worker, max(ts_ms) FILTER (event = 'leased') AS started_ms, arg_min(ts_ms, seq) FILTER (event NOT IN ('leased', 'lease_expired')) AS ended_ms,
  coalesce(arg_min(event, seq) FILTER (event NOT IN ('leased', 'lease_expired')), 'in_flight') AS result, arg_min(coalesce(reason, chr(0)), seq) FILTER (event NOT IN ('leased', 'lease_expired')) AS reason,
  coalesce(min(seq) FILTER (event = 'lease_expired') < coalesce(min(seq) FILTER (event NOT IN ('leased', 'lease_expired')), 9223372036854775807), false) AS lease_expired FROM n WHERE number > 0 GROUP BY 1, 2, 3)
SELECT search_id, task, number, attempt, worker, coalesce(device, '') AS device, coalesce(host, '') AS host, started_ms, ended_ms, result, nullif(reason, chr(0)) AS reason, lease_expired FROM a LEFT JOIN b USING (search_id, worker)""",
    v.JOURNAL,
)
def task_attempts(spark, d):
    return journal.task_attempts(v.journal(spark, d))


_OUTCOMES = f""", o AS (SELECT search_id, task, arg_min(ts_ms, seq) FILTER (event = 'queued') AS queued_ms, arg_max(event, seq) FILTER (event IN ('leased', 'committed', 'rejected', 'faulted')) AS st FROM journal WHERE event IN {_LIFECYCLE} GROUP BY 1, 2),
outcomes AS (SELECT search_id, task, queued_ms, CASE WHEN st = 'leased' THEN 'in_progress' ELSE coalesce(st, 'queued') END AS outcome FROM o)"""


@_query(_OUTCOMES + " SELECT * FROM outcomes", v.JOURNAL)
def task_outcomes(spark, d):
    return journal.task_outcomes(v.journal(spark, d))


@_query(_OUTCOMES + " SELECT * FROM outcomes WHERE outcome IN ('rejected', 'faulted')", v.JOURNAL)
def failed_tasks(spark, d):
    return journal.failed_tasks(v.journal(spark, d))


@_query(
    f""", p AS (SELECT DISTINCT search_id, unnest(['t0', 't07', 't24', 'zz']) AS prefix FROM journal), t AS (SELECT DISTINCT search_id, task FROM journal WHERE event IN {_LIFECYCLE}),
h AS (SELECT p.search_id, p.prefix, count(t.task) AS n, min(t.task) AS task FROM p LEFT JOIN t ON p.search_id = t.search_id AND starts_with(t.task, p.prefix) GROUP BY 1, 2)
SELECT search_id, prefix, CASE n WHEN 1 THEN 'found' WHEN 0 THEN 'no task' ELSE 'ambiguous: ' || n END AS resolution, CASE WHEN n = 1 THEN task END AS task FROM h""",
    v.JOURNAL,
)
def prefix_resolution(spark, d):
    log = v.journal(spark, d)
    asked = log.select("search_id").distinct().withColumn("prefix", F.explode(F.array(*map(F.lit, ("t0", "t07", "t24", "zz")))))
    return journal.prefix_resolution(log, asked)


@_query(
    f""", {_LAST_SESSION}, al AS (SELECT search_id, count(*) FILTER (event = 'committed') AS committed FROM journal GROUP BY 1)
SELECT s.search_id, arg_min(ts_ms, seq) AS start_ms, arg_max(ts_ms, seq) AS end_ms, CAST(coalesce(arg_max(tasks, seq) FILTER (event = 'search_started'), 0) AS BIGINT) AS tasks, count(*) FILTER (event = 'committed') AS session_committed, any_value(al.committed) AS committed
FROM session s JOIN al USING (search_id) GROUP BY 1""",
    v.JOURNAL,
)
def session_bounds(spark, d):
    return journal.session_bounds(v.journal(spark, d))


@_query(
    f""", {_LAST_SESSION} SELECT search_id, count(*) FILTER (event = 'retried') AS retries, count(DISTINCT task) FILTER (event = 'retried') AS retried_tasks, count(*) FILTER (event IN ('failed', 'rejected', 'faulted')) AS failed_attempts, count(*) FILTER (event = 'leased') AS total_attempts FROM session GROUP BY 1""",
    v.JOURNAL,
)
def session_retries(spark, d):
    return journal.session_retries(v.journal(spark, d))


@_query(f", {_METRICS} SELECT * FROM metrics", v.JOURNAL)
def worker_metrics(spark, d):
    return journal.worker_metrics(v.journal(spark, d))


@_query(""" SELECT search_id, task, 'value=' || CAST(CAST(arg_max(stat, seq) AS BIGINT) AS VARCHAR) AS stats FROM journal WHERE event = 'committed' GROUP BY 1, 2""", v.JOURNAL)
def latest_stats(spark, d):
    return journal.latest_stats(v.journal(spark, d)).select("search_id", "task", fn.render_stats(F.col("stats"), F.lit(None).cast("string")).alias("stats"))


@_query(""", l AS (SELECT search_id, task, CAST(CAST(arg_max(stat, seq) AS BIGINT) AS VARCHAR) AS s FROM journal WHERE event = 'committed' GROUP BY 1, 2) SELECT search_id, 'value=' || s AS stats, count(*) AS tasks FROM l GROUP BY 1, 2""", v.JOURNAL)
def stats_histogram(spark, d):
    return journal.stats_histogram(v.journal(spark, d)).select("search_id", fn.render_stats(F.col("stats"), F.lit(None).cast("string")).alias("stats"), "tasks")


@_query(
    """, n AS (SELECT *, count(*) FILTER (event = 'search_started') OVER (PARTITION BY search_id ORDER BY seq) AS ses FROM journal WHERE event IN ('search_started', 'committed')),
m AS (SELECT *, max(restored) OVER w AS base, max(tasks) OVER w AS total, count(*) FILTER (event = 'committed') OVER w AS n FROM n WINDOW w AS (PARTITION BY search_id, ses ORDER BY seq))
SELECT search_id, seq, CAST(coalesce(base, 0) + n AS BIGINT) AS done, CAST(coalesce(total, 0) AS BIGINT) AS tasks FROM m WHERE event = 'committed'""",
    v.JOURNAL,
)
def running_commits(spark, d):
    return journal.running_commits(v.journal(spark, d))


@_query(f" SELECT DISTINCT search_id, sha256(task) AS task FROM journal WHERE event IN {_LIFECYCLE} AND CAST(substr(task, 2) AS INTEGER) % 2 = 0", v.JOURNAL)
def journaled_keys(spark, d):
    """Every other task goes by a key in hex; the others have none."""
    log = v.journal(spark, d)
    even = F.substring("task", 2, 2).cast("int") % 2 == 0
    return journal.journaled_keys(log.withColumn("task", F.when(even, F.sha2(F.col("task").cast("binary"), 256)).otherwise(F.col("task"))))


@_query(" SELECT search_id, arg_max(digest, seq) AS digest FROM journal WHERE event = 'program_bound' GROUP BY 1", v.JOURNAL)
def last_program(spark, d):
    return journal.last_program(v.journal(spark, d))


@_query(
    """, b AS (SELECT search_id, seq, host, device, driver, lag(driver) OVER (PARTITION BY search_id, host, device ORDER BY seq) AS old FROM journal WHERE event = 'worker_bound')
SELECT search_id, seq, host, device, old AS from_driver, driver AS to_driver FROM b WHERE old <> driver""",
    v.JOURNAL,
)
def driver_changes(spark, d):
    return journal.driver_changes(v.journal(spark, d))


@_query(" SELECT search_id, seq, event FROM journal WHERE event NOT IN ('leased', 'checkpointed')", v.JOURNAL)
def narrated_events(spark, d):
    return journal.narrated(v.journal(spark, d)).select("search_id", "seq", "event")


@_query(", x AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY seq DESC) AS k FROM journal) SELECT search_id, seq, event FROM x WHERE k <= 100", v.JOURNAL)
def last_lines(spark, d):
    return journal.last_lines(v.journal(spark, d), 100).select("search_id", "seq", "event")


@_query(
    f""", {_LAST_SESSION}, {_BUCKETS}, c AS (SELECT s.search_id, s.seq, max(b."column") AS col FROM session s JOIN buckets b ON s.search_id = b.search_id AND (s.ts_ms >= b.from_ms OR b."column" = 0) WHERE s.event = 'committed' GROUP BY 1, 2),
n AS (SELECT search_id, col, count(*) AS k FROM c GROUP BY 1, 2), m AS (SELECT b.search_id, b."column", coalesce(k, 0) AS commits, max(coalesce(k, 0)) OVER (PARTITION BY b.search_id) AS top FROM buckets b LEFT JOIN n ON n.search_id = b.search_id AND n.col = b."column")
SELECT search_id, "column", commits, CASE WHEN commits > 0 THEN (commits * 8 + top - 1) // top ELSE 0 END AS level FROM m""",
    v.JOURNAL,
)
def commit_sparkline(spark, d):
    return journal.commit_sparkline(v.journal(spark, d))


@_query(
    f""", {_METRICS}, {_BUCKETS}, o AS (SELECT s.search_id, s.worker, b."column", sum(least(s.end_ms, b.to_ms) - greatest(s.start_ms, b.from_ms)) AS busy FROM spans s JOIN buckets b ON s.search_id = b.search_id AND s.start_ms < b.to_ms AND s.end_ms > b.from_ms GROUP BY 1, 2, 3)
SELECT m.search_id, m.worker, b."column", CAST(coalesce(busy, 0) AS BIGINT) AS busy_ms, CASE WHEN b.to_ms <= m.first_bind_ms THEN 'blank' WHEN b.to_ms > b.from_ms AND coalesce(busy, 0) * 2 >= b.to_ms - b.from_ms THEN 'full' ELSE 'light' END AS glyph
FROM metrics m JOIN buckets b USING (search_id) LEFT JOIN o ON o.search_id = m.search_id AND o.worker = m.worker AND o."column" = b."column" """,
    v.JOURNAL,
)
def occupancy_buckets(spark, d):
    return journal.occupancy_buckets(v.journal(spark, d))


@_query(
    f""", {_STATE}, s AS (SELECT search_id, arg_max(tasks, seq) FILTER (event = 'search_started') AS tasks, count(*) FILTER (event = 'committed') AS committed, count(*) FILTER (event = 'rejected') AS rejected, count(*) FILTER (event = 'faulted') AS faulted FROM journal GROUP BY 1)
SELECT CAST(r AS VARCHAR) AS search_id, CAST(coalesce(tasks, 0) AS BIGINT) AS tasks, coalesce(committed, 0) AS committed, coalesce(rejected, 0) AS rejected, coalesce(faulted, 0) AS faulted, coalesce(state.state, 'in_progress') AS state FROM range(12) t(r) LEFT JOIN s ON s.search_id = CAST(r AS VARCHAR) LEFT JOIN state ON state.search_id = CAST(r AS VARCHAR)""",
    v.JOURNAL,
)
def search_summaries(spark, d):
    return journal.search_summaries(spark.range(12).select(F.col("id").cast("string").alias("search_id")), v.journal(spark, d))


# ---- ledgers

_CHARGED = f"""
op AS (SELECT i.owner, i.tag, i.price_micro_usd_hour AS rate, i.created_ms AS started_ms, least(CAST(ceil_q AS HUGEINT), 18446744073709551615::HUGEINT) AS accrued FROM (
  SELECT i.*, (CAST(i.price_micro_usd_hour AS HUGEINT) * greatest(0, {v.NOW_MS} - i.created_ms) + 3599999) // 3600000 AS ceil_q FROM instances i WHERE NOT EXISTS (SELECT 1 FROM spend s WHERE s.owner = i.owner AND s.tag = i.tag AND s.started_ms = i.created_ms)) i),
report AS (SELECT owner, CAST(sum(closed) AS BIGINT) AS closed, count(*) FILTER (closed = 0) AS open, min(started_ms) AS first_ms, CAST(sum(cost) AS DECIMAL(20,0)) AS total FROM (
  SELECT owner, started_ms, CAST(cost_micro_usd AS HUGEINT) AS cost, 1 AS closed FROM spend UNION ALL SELECT owner, started_ms, accrued, 0 FROM op) GROUP BY 1)"""


@_query(f", {_CHARGED} SELECT owner, tag, CAST(rate AS DECIMAL(20,0)) AS rate, started_ms, CAST(accrued AS DECIMAL(20,0)) AS accrued FROM op", v.INSTANCES)
def open_rentals(spark, d):
    return ledger.open_rentals(v.instances(spark, d), v.spend(spark, d), v.NOW_MS)


@_query(f", {_CHARGED} SELECT * FROM report", v.INSTANCES)
def spend_report(spark, d):
    return ledger.spend_report(v.instances(spark, d), v.spend(spark, d), v.NOW_MS)


_CAP, _WALL = 400_000_000_000, 190_000_000_000


@_query(f", {_CHARGED} SELECT owner, total, CAST(first_ms + {_WALL} AS DECIMAL(20,0)) AS deadline_ms, CASE WHEN total >= {_CAP} THEN 'spend' WHEN {v.NOW_MS} >= first_ms + {_WALL} THEN 'wall_clock' ELSE 'within' END AS verdict FROM report", v.INSTANCES)
def budget_verdict(spark, d):
    return ledger.budget_verdict(ledger.spend_report(v.instances(spark, d), v.spend(spark, d), v.NOW_MS), v.NOW_MS, _CAP, _WALL)


@_query(
    """ SELECT provider, machine, count(*) AS incidents, count(*) FILTER (kind = 'lost') AS lost, count(*) FILTER (kind = 'never_ready') AS never_ready, count(*) FILTER (kind = 'probe_failed') AS probe_failed, count(*) FILTER (kind = 'install_failed') AS install_failed,
  min(occurred_ms) AS first_ms, max(occurred_ms) AS last_ms, count(*) >= 2 AS blacklisted FROM incidents GROUP BY 1, 2""",
    v.INCIDENTS,
)
def machine_report(spark, d):
    return ledger.machine_report(v.incidents(spark, d))


@_query(" SELECT provider, machine, count(*) AS strikes FROM incidents GROUP BY 1, 2 HAVING count(*) >= 2", v.INCIDENTS)
def excluded_machines(spark, d):
    return ledger.excluded_machines(v.incidents(spark, d))


_CONSTRAINTS = ledger.Constraints(gpu_models=("BRASS", "steel", "an"), verified_only=True, min_gpu_count=5, min_cuda=12.0, min_reliability=0.6, max_price=1_600_000_000)


@_query(
    """, ex AS (SELECT DISTINCT machine FROM incidents WHERE provider = 'p1' GROUP BY provider, machine HAVING count(*) >= 2)
SELECT id, machine, gpu_model, price FROM offers WHERE (contains(lower(gpu_model), 'brass') OR contains(lower(gpu_model), 'steel') OR contains(lower(gpu_model), 'an')) AND verified AND gpu_count >= 5 AND cuda >= 12.0 AND NOT isnan(reliability) AND reliability >= 0.6 AND price <= 1600000000
  AND (machine = '' OR machine NOT IN (SELECT machine FROM ex)) ORDER BY price, id LIMIT 25""",
    v.OFFERS,
    v.INCIDENTS,
)
def offer_select_topk(spark, d):
    return ledger.select_offers(v.offers(spark, d), _CONSTRAINTS, ledger.excluded_machines(v.incidents(spark, d)), 25, "p1").select("id", "machine", "gpu_model", "price")


@_query(
    """, s AS (SELECT * FROM instances WHERE provider = 'p1' AND role = 'worker'), byi AS (SELECT id, min(price) AS price FROM listing GROUP BY 1), byt AS (SELECT tag, id, price FROM listing),
j AS (SELECT s.*, byi.id IS NOT NULL AS listed, byi.price AS ip, byt.id AS tid, byt.price AS tp, CAST(s.owner AS BIGINT) % 4 = 0 AS locked, s.instance IS NOT NULL AND CAST(substr(s.tag, 2) AS BIGINT) % 8 = 0 AS gone FROM s LEFT JOIN byi ON byi.id = s.instance LEFT JOIN byt ON byt.tag = s.tag),
k AS (SELECT *, CASE WHEN locked THEN 'keep' WHEN state = 'live' AND (listed OR NOT gone) OR state = 'intent' AND tid IS NOT NULL THEN 'destroy' ELSE 'close' END AS verdict FROM j)
SELECT tag, verdict, CASE WHEN verdict = 'destroy' THEN CASE WHEN state = 'live' THEN instance ELSE tid END END AS instance, CAST(CASE WHEN verdict <> 'keep' THEN coalesce(CASE WHEN verdict = 'destroy' THEN CASE WHEN state = 'live' THEN ip ELSE tp END END, price_micro_usd_hour) END AS DECIMAL(20,0)) AS rate FROM k""",
    v.INSTANCES,
    v.LISTING,
)
def reconcile_verdicts(spark, d):
    rows = v.instances(spark, d)
    locked = rows.where(F.col("owner").cast("long") % 4 == 0).select("owner")
    gone = rows.where("instance is not null").where(F.substring("tag", 2, 20).cast("long") % 8 == 0).select(F.col("instance").alias("id"))
    return ledger.reconcile(rows, v.listing(spark, d), "p1", locked, gone)


@_query(
    """ SELECT tag, arg_max(rate, g) AS rate FROM (SELECT tag, price_micro_usd_hour AS rate, 0 AS g FROM instances UNION ALL SELECT tag, CAST(price_micro_usd_hour * 2 AS DECIMAL(20,0)), 1 FROM instances WHERE state = 'intent') GROUP BY 1""",
    v.INSTANCES,
)
def ledger_upsert(spark, d):
    rows = v.instances(spark, d).select("tag", F.col("price_micro_usd_hour").alias("rate"), "created_ms", "state")
    changed = rows.where("state = 'intent'").withColumn("rate", (F.col("rate") * 2).cast("decimal(20,0)"))
    return ledger.upsert(rows, changed, ["tag"], "created_ms").select("tag", "rate")


_DEVICES = "dv AS (SELECT s_nationkey AS host, s_suppkey AS idx, 'c' || (s_suppkey % 2) AS class, ['discrete', 'integrated', 'virtual', 'cpu', 'other'][CASE WHEN s_nationkey % 3 = 0 THEN 4 ELSE s_suppkey % 5 + 1 END] AS device_type FROM supplier)"


def _devices(spark, d):
    kinds = F.array(*map(F.lit, ("discrete", "integrated", "virtual", "cpu", "other")))
    at = F.when(F.col("s_nationkey") % 3 == 0, 4).otherwise((F.col("s_suppkey") % 5 + 1).cast("int"))
    return v.read(spark, d, "supplier").select(F.col("s_nationkey").alias("host"), F.col("s_suppkey").alias("idx"), F.concat(F.lit("c"), (F.col("s_suppkey") % 2).cast("string")).alias("class"), F.element_at(kinds, at).alias("device_type"))


@_query(" SELECT host, idx, class, device_type FROM (SELECT *, max(CASE WHEN device_type <> 'cpu' THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS o FROM dv) WHERE o = 0 OR device_type <> 'cpu'", _DEVICES)
def usable_devices(spark, d):
    return ledger.usable_devices(_devices(spark, d), "host")


@_query(" SELECT host, idx, class, CAST(row_number() OVER (PARTITION BY host, class ORDER BY idx) - 1 AS INTEGER) AS member FROM dv", _DEVICES)
def device_members(spark, d):
    return ledger.device_members(_devices(spark, d), "host").select("host", "idx", "class", "member")


@_query(" SELECT host, arg_min(idx, list_position(['discrete', 'integrated', 'virtual', 'cpu', 'other'], device_type)::BIGINT * 1000000000 + idx) AS idx FROM dv GROUP BY 1", _DEVICES)
def default_device(spark, d):
    return ledger.default_device(_devices(spark, d), "host")


@_query(", m AS (SELECT *, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY idx) - 1 AS k FROM dv) SELECT host, CAST(s AS INTEGER) AS slot, idx FROM m, range(6) t(s) WHERE s % n = k", _DEVICES)
def round_robin_slots(spark, d):
    return ledger.slots(_devices(spark, d), "host", 6)


# ---- the store

_LIVE = """, live AS (SELECT DISTINCT object FROM (SELECT record_hash AS object FROM manifests JOIN searches USING (search_id) WHERE finalized UNION ALL SELECT object FROM manifests JOIN searches USING (search_id) JOIN refs USING (record_hash) WHERE finalized)),
held AS (SELECT DISTINCT object FROM (SELECT object FROM refs UNION ALL SELECT record_hash FROM manifests))"""


def _held(spark, d):
    return v.references(spark, d).select("object").unionByName(v.manifests(spark, d).select(F.col("record_hash").alias("object"))).distinct()


@_query(" SELECT DISTINCT search_id, object FROM (SELECT search_id, record_hash AS object FROM manifests UNION ALL SELECT search_id, object FROM manifests JOIN refs USING (record_hash))", v.STORE)
def search_closure(spark, d):
    return store.closure(v.manifests(spark, d), v.references(spark, d))


@_query(_LIVE + " SELECT object FROM held WHERE object NOT IN (SELECT object FROM live)", v.STORE)
def gc_doomed(spark, d):
    return store.gc_doomed(_held(spark, d), store.live_objects(v.searches(spark, d), v.manifests(spark, d), v.references(spark, d)))


@_query(_LIVE + " SELECT search_id, task_key, record_hash FROM manifests WHERE record_hash NOT IN (SELECT object FROM live)", v.STORE)
def gc_index_rows(spark, d):
    m, r = v.manifests(spark, d), v.references(spark, d)
    doomed = store.gc_doomed(_held(spark, d), store.live_objects(v.searches(spark, d), m, r))
    return store.doomed_index(m, doomed).select("search_id", "task_key", "record_hash")


@_query(
    """, one AS (SELECT min(search_id) AS s FROM manifests), mine AS (SELECT DISTINCT object FROM (SELECT search_id, record_hash AS object FROM manifests UNION ALL SELECT search_id, object FROM manifests JOIN refs USING (record_hash)), one WHERE search_id = s),
others AS (SELECT DISTINCT object FROM (SELECT search_id, record_hash AS object FROM manifests UNION ALL SELECT search_id, object FROM manifests JOIN refs USING (record_hash)), one WHERE search_id <> s) SELECT object FROM mine WHERE object NOT IN (SELECT object FROM others)""",
    v.STORE,
)
def removal_plan(spark, d):
    """The guarded operator over a store in which every other search is finalized."""
    m = v.manifests(spark, d)
    first = m.agg(F.min("search_id")).first()[0]
    known = v.searches(spark, d).withColumn("finalized", F.col("search_id") != first)
    return store.removal_plan(first, known, m, v.references(spark, d))


@_query(" SELECT o_orderkey AS task_key, 'r' || o_orderkey AS record FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 2 = 0)")
def sync_want(spark, d):
    theirs, mine = _two_stores(spark, d)
    return store.sync_want(theirs, mine)


def _two_stores(spark, d):
    o = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("task_key"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record"))
    key = F.col("task_key")
    return o.where(key % 3 != 0), o.where(key % 2 == 0).withColumn("record", F.when(key % 1000 == 2, F.concat("record", F.lit("x"))).otherwise(F.col("record")))


@_query(" SELECT o_orderkey AS task_key, 'r' || o_orderkey AS their_record, 'r' || o_orderkey || 'x' AS my_record FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 1000 = 2")
def sync_divergence(spark, d):
    return store.sync_divergence(*_two_stores(spark, d))


@_query(" SELECT object FROM (SELECT DISTINCT 'a' || l_orderkey || '-' || l_linenumber AS object FROM lineitem WHERE l_linenumber <> 1 UNION SELECT DISTINCT 'p' || l_partkey FROM lineitem)")
def push_objects(spark, d):
    r = v.references(spark, d).select("object")
    own = r.where(F.col("object").startswith("a"))
    return store.push_objects(r.where(F.col("object").startswith("p")), own, own.where(F.col("object").endswith("-1")))


@_query(" SELECT o_orderkey AS task_key FROM orders WHERE o_orderstatus <> 'F'")
def frontier(spark, d):
    o = v.read(spark, d, "orders")
    key = F.col("o_orderkey").alias("task_key")
    return store.frontier(o.select(key), o.where("o_orderstatus = 'F'").select(key))


@_query(" SELECT sha256(coalesce(text, '')) AS hash, count(*) AS copies FROM documents GROUP BY 1")
def cas_dedup(spark, d):
    rows = v.read(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    new = store.put(rows.limit(0), rows)
    return rows.groupBy("hash").agg(F.count("*").alias("copies")).join(new.select("hash"), "hash", "left_semi")


@_query(" SELECT count(*) FILTER (starts_with(h, '00')) * 256 AS estimate FROM (SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR)) AS h FROM lineitem)")
def loose_estimate(spark, d):
    return store.loose_estimate(v.read(spark, d, "lineitem").select(F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256).alias("hash")).distinct())


@_query(" SELECT h AS hash, k % 2 = 0 AS duplicate FROM (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) WHERE k % 3 <> 0")
def loose_split(spark, d):
    o = v.read(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"))
    return store.loose_split(o.where("o_orderkey % 3 <> 0").select("hash"), o.where("o_orderkey % 2 = 0").select("hash"))


_PACK_CAP = 200_000


@_query(
    f"""WITH RECURSIVE o AS (SELECT hash, size, CAST('0x' || substr(hash, 1, 1) AS INTEGER) AS shard, row_number() OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash) AS k FROM (SELECT DISTINCT sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents)),
w AS (SELECT shard, k, size, 0 AS pack, size AS total FROM o WHERE k = 1 UNION ALL SELECT o.shard, o.k, o.size, CASE WHEN w.total + o.size > {_PACK_CAP} THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.total + o.size > {_PACK_CAP} THEN o.size ELSE w.total + o.size END FROM w JOIN o ON o.shard = w.shard AND o.k = w.k + 1)
SELECT shard, pack, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY 1, 2"""
)
def pack_groups(spark, d):
    text = F.coalesce("text", F.lit(""))
    objects = v.read(spark, d, "documents").select(F.sha2(text.cast("binary"), 256).alias("hash"), F.octet_length(text).cast("long").alias("size")).distinct()
    return store.pack_groups(objects, _PACK_CAP)


@_query(""" SELECT search_id, '[' || string_agg('{"task":' || task_key || ',"record":"' || record_hash || '"}', ',' ORDER BY task_key, record_hash) || ']' AS json FROM manifests GROUP BY 1""", v.STORE)
def manifest(spark, d):
    return store.manifest_json(v.manifests(spark, d))


@_query(" SELECT c AS owner, f AS frame, count(*) AS entries, min(k) AS first, max(k) AS last FROM (SELECT o_orderstatus AS c, o_orderkey AS k, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 4096 AS BIGINT) AS f FROM orders) GROUP BY 1, 2")
def inventory_frames(spark, d):
    rows = v.read(spark, d, "orders").select(F.col("o_orderstatus").alias("owner"), "o_orderkey")
    return store.frames(rows, "owner", "o_orderkey")


@_query(
    """ SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)"""
)
def missing_references(spark, d):
    refs = v.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("object"))
    held = v.read(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("object"))
    return store.missing_references(refs, held).select("l_orderkey", "l_linenumber")


@_query(" SELECT o_custkey AS search_id, o_orderkey AS task, before FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS p, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before >= p")
def ascending_faults(spark, d):
    rows = v.read(spark, d, "orders").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("p"))
    return store.ascending_faults(rows, "search_id", "p", "task").select("search_id", "task", "before")


_SEGMENTS = 6


@_query(
    f"""WITH RECURSIVE l AS (SELECT o_orderkey AS state, max(o_orderkey * 7 % 6000 + 1) AS nxt FROM orders GROUP BY 1), w AS (SELECT o_orderkey AS chain, 0 AS segment, o_orderkey AS state FROM orders UNION ALL SELECT w.chain, w.segment + 1, l.nxt FROM w JOIN l ON w.state = l.state WHERE w.segment + 1 < {_SEGMENTS}) SELECT * FROM w"""
)
def chain_walk(spark, d):
    o = v.read(spark, d, "orders").select("o_orderkey")
    links = o.select(F.col("o_orderkey").alias("state"), (F.col("o_orderkey") * 7 % 6000 + 1).alias("next_state"))
    return store.chain_walk(spark, o.select(F.col("o_orderkey").alias("chain"), F.col("o_orderkey").alias("state")), links, _SEGMENTS)


# ---- generation and simulation

_ROOT = 42
_U = "18446744073709551616::HUGEINT"


def _sql_mul(x: str, c: int) -> str:
    """Product modulo 2^64 of unsigned 64-bit SQL values held in HUGEINT, in two halves."""
    low = f"(({x}) & 4294967295::HUGEINT) * {c}::HUGEINT"
    high = f"(((({x}) >> 32) * {c & 0xFFFFFFFF}::HUGEINT) & 4294967295::HUGEINT) << 32"
    return f"((({low}) + ({high})) % {_U})"


def _finalised(n: int, source: str) -> str:
    """CTEs that finalise column z of ``source`` into column r of table d{n}."""
    return f"""a{n} AS (SELECT * EXCLUDE z, xor(z, z >> 30) AS z FROM ({source})), b{n} AS (SELECT * EXCLUDE z, {_sql_mul("z", 0xBF58476D1CE4E5B9)} AS z FROM a{n}), c{n} AS (SELECT * EXCLUDE z, xor(z, z >> 27) AS z FROM b{n}), e{n} AS (SELECT * EXCLUDE z, {_sql_mul("z", 0x94D049BB133111EB)} AS z FROM c{n}), d{n} AS (SELECT * EXCLUDE z, xor(z, z >> 31) AS r FROM e{n})"""


_DERIVED = f"""{_finalised(1, "SELECT i, CAST(i AS HUGEINT) AS z FROM ids")}, {_finalised(2, f"SELECT i, xor({_ROOT}::HUGEINT, r) AS z FROM d1")}"""
_DRAWS = f"""{_DERIVED}, {_finalised(3, f"SELECT i, k, (r + {_sql_mul('(k + 1)::HUGEINT', 0x9E3779B97F4A7C15)}) % {_U} AS z FROM d2, range(4) t(k)")}"""
_HEX = "printf('%08X', (r >> 32)::BIGINT) || printf('%08X', (r & 4294967295::HUGEINT)::BIGINT)"


@_query(f"WITH ids AS (SELECT o_orderkey AS i FROM orders), {_DRAWS} SELECT i, CAST(k AS INTEGER) AS k, {_HEX} AS word, (r >> 11)::DOUBLE * pow(2.0, -53) AS unit FROM d3")
def prng_draws(spark, d):
    rows = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    word = fn.with_draws(rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")), _ROOT, "i", "k", "w")
    return word.select("i", "k", fn.hex64(F.col("w")).alias("word"), fn.unit_f64(F.col("w")).alias("unit"))


_RANGES = {"feed": (0.010, 0.110), "kill": (0.045, 0.070), "du": (0.16, 0.16), "dv": (0.08, 0.08)}


@_query(
    f"WITH ids AS (SELECT range AS i FROM range(1000)), {_DRAWS}, u AS (SELECT i, k, (r >> 11)::DOUBLE * pow(2.0, -53) AS t FROM d3) SELECT i, "
    + ", ".join(f"max(CASE WHEN k = {k} THEN CAST({lo}::DOUBLE + t * ({hi}::DOUBLE - {lo}::DOUBLE) AS FLOAT) END) AS {n}" for k, (n, (lo, hi)) in enumerate(_RANGES.items()))
    + " FROM u GROUP BY i"
)
def genomes(spark, d):
    return generate.reaction_genomes(generate.candidates(spark, _ROOT, 1000), _RANGES).drop("nonce")


@_query()
def network_genomes(spark, d):
    return generate.network_genomes(generate.candidates(spark, _ROOT, 50), 0.5).select("i", "weights")


_PATCH = {"width": 12, "height": 10, "background": [1.0, 0.0], "patch": [0.5, 0.25], "divisor": 3, "noise": 0.1}


@_query(
    f"WITH ids AS (SELECT range AS i FROM range(5)), {_DERIVED}, cells AS (SELECT i, r AS s, x, y, c FROM d2, range(12) a(x), range(10) b(y), range(2) e(c)), {_finalised(4, 'SELECT i, s, x, y, c, CAST(y * 12 + x AS HUGEINT) AS z FROM cells')}, {_finalised(5, 'SELECT i, x, y, c, xor(s, r) AS z FROM d4')}, "
    f"{_finalised(6, f'SELECT i, x, y, c, (r + {_sql_mul("(c + 1)::HUGEINT", 0x9E3779B97F4A7C15)}) % {_U} AS z FROM d5')} "
    "SELECT i, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(c AS INTEGER) AS c, CASE WHEN x BETWEEN 4 AND 6 AND y BETWEEN 3 AND 5 THEN CASE WHEN c = 0 THEN 0.5::FLOAT ELSE 0.25::FLOAT END * (1.0::FLOAT + (CAST((r >> 11)::DOUBLE * pow(2.0, -53) AS FLOAT) - 0.5::FLOAT) * 0.1::FLOAT) ELSE CASE WHEN c = 0 THEN 1.0::FLOAT ELSE 0.0::FLOAT END END AS v FROM d6"
)
def ignition_grid(spark, d):
    return generate.ignition(generate.candidates(spark, _ROOT, 5), **_PATCH)


_REDUCED = """, q AS (SELECT cand, c, list_transform(range(c + 1, 65, 4), lambda i: current[i]::DOUBLE) AS own, current, previous FROM grids, range(4) t(c)),
s AS (SELECT cand, c, list_avg(own) AS mean, list_var_pop(own) AS var, list_min(own) AS lo, list_max(own) AS hi FROM q),
g AS (SELECT cand, len(list_filter(list_transform(range(2, 65, 4), lambda i: current[i]), lambda x: x >= 0.1)) / 16.0::DOUBLE AS population, list_sum(list_transform(range(1, 65), lambda i: abs(current[i]::DOUBLE - previous[i]::DOUBLE))) / 64 AS activity FROM grids)"""


@_query(
    _REDUCED
    + " SELECT cand, 'c' || c || '.' || n AS name, round(CASE n WHEN 'mean' THEN mean WHEN 'var' THEN var WHEN 'min' THEN lo ELSE hi END, 9) AS value FROM s, (SELECT unnest(['mean', 'var', 'min', 'max']) AS n) UNION ALL SELECT cand, 'population', round(population, 9) FROM g UNION ALL SELECT cand, 'activity', round(activity, 9) FROM g",
    v.GRIDS,
)
def grid_reduce(spark, d):
    got = simulate.grid_reduce(v.grids(spark, d), 4, 1, 0.1)
    return got.select("cand", F.explode("stats").alias("s")).select("cand", "s.name", F.round("s.value", 9).alias("value"))


@_query(_REDUCED + " SELECT cand, population >= 0.25 AS keep FROM g", v.GRIDS)
def snapshot_keep(spark, d):
    return simulate.keep_snapshot(simulate.grid_reduce(v.grids(spark, d), 4, 1, 0.1), "population", 0.25).select("cand", "keep")


_CELLS = """ids AS (SELECT vec_id AS i, embedding AS g FROM embeddings), cells AS (SELECT i, x, y, c, g FROM ids, range(4) a(x), range(4) b(y), range(4) e(c))"""


@_query(
    f"WITH {_CELLS} SELECT i, CAST((y * 4 + x) * 4 + c AS INTEGER) AS p, greatest(g[(y * 4 + x) * 4 + c + 1], g[(y * 4 + (x + 3) % 4) * 4 + c + 1], g[(y * 4 + (x + 1) % 4) * 4 + c + 1], g[((y + 3) % 4 * 4 + x) * 4 + c + 1], g[((y + 1) % 4 * 4 + x) * 4 + c + 1]) AS v FROM cells"
)
def smoke_max(spark, d):
    rows = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("grid"))
    return simulate.run_smoke(rows, 4, 4, 4, 1).select("i", F.posexplode("current").alias("p", "v"))


_SUM = " + ".join(f"g[({y} * 8 + {x}) * 2 + {{c}}]" for x, y in (("(x + 7) % 8", "y"), ("(x + 1) % 8", "y"), ("x", "(y + 3) % 4"), ("x", "(y + 1) % 4")))


@_query(
    "WITH ids AS (SELECT vec_id AS i, embedding::FLOAT[] AS g FROM embeddings), n AS (SELECT i, x, y, g FROM ids, range(8) a(x), range(4) b(y)), "
    f"m AS (SELECT i, x, y, g[(y * 8 + x) * 2 + 1] AS u, g[(y * 8 + x) * 2 + 2] AS w, {_SUM.format(c=1)} AS su, {_SUM.format(c=2)} AS sw FROM n), "
    "l AS (SELECT i, x, y, u, w, su - 4.0::FLOAT * u AS lu, sw - 4.0::FLOAT * w AS lw, u * w * w AS uww FROM m) "
    "SELECT i, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, u + 1.0::FLOAT * (0.16::FLOAT * lu - uww + 0.05::FLOAT * (1.0::FLOAT - u)) AS u, w + 1.0::FLOAT * (0.08::FLOAT * lw + uww - (0.05::FLOAT + 0.06::FLOAT) * w) AS v FROM l"
)
def reaction_step(spark, d):
    rows = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("grid"), F.lit(0.05).alias("feed"), F.lit(0.06).alias("kill"), F.lit(0.16).alias("du"), F.lit(0.08).alias("dv"))
    out = simulate.run_reaction(rows, 8, 4, 1).select("i", F.posexplode("current").alias("p", "v"))
    cell = F.floor(F.col("p") / 2)
    long = out.select("i", (cell % 8).cast("int").alias("x"), F.floor(cell / 8).cast("int").alias("y"), F.when(F.col("p") % 2 == 0, F.col("v")).alias("a"), F.when(F.col("p") % 2 == 1, F.col("v")).alias("b"))
    return long.groupBy("i", "x", "y").agg(F.max("a").alias("u"), F.max("b").alias("v"))


@_query()
def reaction_search(spark, d):
    """Candidates drawn, ignited, run and reduced, end to end."""
    size = 16
    rows = generate.reaction_genomes(generate.candidates(spark, _ROOT, 40), _RANGES)
    cells = generate.ignition(rows.select("i", "nonce"), size, size, [1.0, 0.0], [0.5, 0.25], 4, 0.1)
    at = (F.col("y") * size + F.col("x")) * 2 + F.col("c")
    grids = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(at.alias("p"), "v"))).alias("g")).select("i", F.transform("g", lambda x: x["v"]).alias("grid"))
    out = simulate.run_reaction(rows.join(grids, "i"), size, size, 100)
    return simulate.keep_snapshot(simulate.grid_reduce(out, 2, 1, 0.1, "i"), "population", 0.01)


@_query()
def network_search(spark, d):
    """The neural rule over drawn weights, from an ignition of all 8 channels."""
    size = 8
    rows = generate.network_genomes(generate.candidates(spark, _ROOT, 20), 0.1)
    cells = generate.ignition(rows.select("i", "nonce"), size, size, [0.0] * 8, [1.0] * 8, 4, 0.1)
    at = (F.col("y") * size + F.col("x")) * 8 + F.col("c")
    grids = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(at.alias("p"), "v"))).alias("g")).select("i", F.transform("g", lambda x: x["v"]).alias("grid"))
    out = simulate.run_network(rows.join(grids, "i").withColumn("start", F.lit(0).cast("long")), size, size, 20)
    return simulate.grid_reduce(out, 8, 3, 0.1, "i")


_BEHAVIOURS = ("succeed", "flaky", "panic", "reject", "sleep", "accumulate")


@_query(
    f"WITH t AS (SELECT o_orderkey AS i, {list(_BEHAVIOURS)}[o_orderkey % 6 + 1] AS b, CAST(o_custkey % 5 AS BIGINT) AS n FROM orders) SELECT i, CASE WHEN b = 'flaky' THEN least(n + 1, 3) ELSE 1 END AS attempts, CASE WHEN b = 'flaky' THEN CASE WHEN n < 3 THEN 'committed' ELSE 'search_failed' END WHEN b IN ('panic', 'reject') THEN 'rejected' ELSE 'committed' END AS outcome FROM t"
)
def executor_outcomes(spark, d):
    behaviour = F.element_at(F.array(*map(F.lit, _BEHAVIOURS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    tasks = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderkey").alias("seed"), behaviour.alias("behaviour"), (F.col("o_custkey") % 5).cast("long").alias("n"))
    return generate.stub_outcomes(tasks).select("i", "attempts", "outcome")


@_query(
    f"WITH ids AS (SELECT o_orderkey AS i FROM orders), {_finalised(1, 'SELECT i, 0::HUGEINT AS z FROM ids')}, {_finalised(2, 'SELECT i, xor(CAST(i AS HUGEINT), r) AS z FROM d1')}, {_finalised(3, 'SELECT i, r AS s, 1::HUGEINT AS z FROM d2')}, {_finalised(4, 'SELECT i, xor(s, r) AS z FROM d3')} SELECT i, {_HEX} AS acc FROM d4"
)
def accumulated(spark, d):
    """Two folds of each seed by the absolute step."""
    rows = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    return rows.select("i", fn.hex64(generate.accumulate(F.col("i").cast("long"), F.lit(0).cast("long"), 2)).alias("acc"))


@_query(
    """, o AS (SELECT search_id, worker, list(struct_pack(seq := seq, t := ts_ms) ORDER BY seq) AS xs FROM journal WHERE event = 'worker_bound' GROUP BY 1, 2),
f AS (SELECT search_id, worker, list_reduce(list_prepend(struct_pack(last := -1::BIGINT, n := [0::BIGINT]), list_transform(xs, lambda x: struct_pack(last := x.t, n := [x.seq]))), lambda a, x: CASE WHEN a.last < 0 OR x.last - a.last >= 3600000 THEN struct_pack(last := x.last, n := list_concat(a.n, x.n)) ELSE a END) AS r FROM o)
SELECT search_id, worker, unnest(r.n[2:]) AS seq FROM f""",
    v.JOURNAL,
)
def liveness_lines(spark, d):
    rows = v.journal(spark, d).where("event = 'worker_bound'").select("search_id", "worker", "seq", "ts_ms")
    return live.limited(rows, ["search_id", "worker"], 3_600_000).select("search_id", "worker", "seq")


# ---- placement and narration


@_query(
    """, c AS (SELECT *, count(*) FILTER (event = 'search_started') OVER (PARTITION BY search_id ORDER BY seq) AS ses FROM journal), d AS (SELECT *, max(CASE WHEN event = 'search_started' THEN restored END) OVER w AS base, max(tasks) OVER w AS total, count(*) FILTER (event = 'committed') OVER w AS n FROM c WINDOW w AS (PARTITION BY search_id, ses ORDER BY seq))
SELECT search_id, seq, CASE event WHEN 'search_started' THEN CASE WHEN restored > 0 THEN 'resuming: ' || restored || '/' || tasks || ' committed, ' || greatest(0, tasks - restored) || ' outstanding' ELSE 'started: ' || tasks || ' tasks' END
  WHEN 'retried' THEN 'retrying ' || task || ' (attempt ' || next_attempt || ')' WHEN 'faulted' THEN 'fault ' || task || ': ' || error WHEN 'lease_expired' THEN 'lease expired ' || task || ' (' || elapsed_ms || ' ms)' WHEN 'checkpoint_degraded' THEN 'checkpoint degraded ' || task || ': ' || error
  WHEN 'checkpointed' THEN 'task ' || task || ' checkpointed (worker ' || worker || ')' WHEN 'search_finalized' THEN 'finalized: ' || restored || ' tasks committed' WHEN 'search_failed' THEN 'search failed on ' || task || ': ' || reason
  WHEN 'search_interrupted' THEN 'interrupted: store resumable, run the search again to continue' WHEN 'chain_rebound' THEN 'chain ' || chain || ' rebound: d0 is absent, continuing on d1'
  WHEN 'committed' THEN 'committed ' || (coalesce(base, 0) + n) || '/' || coalesce(total, 0) || '  ' || task WHEN 'rejected' THEN 'rejected ' || task || ': ' || reason WHEN 'failed' THEN 'failed ' || task || ' (attempt ' || attempt || '): ' || reason WHEN 'leased' THEN 'task ' || task || ' started (worker ' || worker || ')' END AS line
FROM d WHERE event NOT IN ('queued', 'worker_bound', 'program_bound')""",
    v.JOURNAL,
)
def narration(spark, d):
    return render.narrate(v.journal(spark, d))


@_query(
    f""", s AS (SELECT DISTINCT host, unnest(['C1', 'disc', 'c', 'zz', 'c1']) AS "select", unnest([0, 1, 2, 3, 4]) AS ord FROM dv), m AS (SELECT s.host, s."select", s.ord, count(DISTINCT class) AS k, min(class) AS class, count(class) AS members FROM s LEFT JOIN (SELECT host AS h, class, device_type AS name FROM dv) ON h = host AND (lower("select") = lower(class) OR contains(lower(name), lower("select"))) GROUP BY 1, 2, 3),
e AS (SELECT *, count(*) FILTER (k = 1) OVER (PARTITION BY host, class ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), f AS (SELECT *, CASE WHEN k = 0 THEN 'no device' WHEN k > 1 THEN k || ' devices' WHEN before > 0 THEN 'taken' ELSE 'found' END AS verdict FROM e)
SELECT host, "select", ord, verdict, CASE WHEN verdict = 'found' THEN class END AS class, CASE WHEN verdict = 'found' THEN members END AS members FROM f""",
    _DEVICES,
)
def selector_resolution(spark, d):
    devices = _devices(spark, d).withColumn("name", F.col("device_type"))
    texts = F.array(*map(F.lit, ("C1", "disc", "c", "zz", "c1")))
    asked = devices.select("host").distinct().select("host", F.posexplode(texts).alias("ord", "select"))
    return placement.resolve_selectors(asked, devices, "host")


@_query(" SELECT host, class, idx FROM (SELECT *, row_number() OVER (PARTITION BY host, class ORDER BY idx) AS n FROM dv) WHERE n = 1", _DEVICES)
def member_lookup(spark, d):
    return placement.member_index(_devices(spark, d), "host", 0)


@_query(
    """ SELECT s_nationkey AS search_id, class, arg_min(task, s_suppkey) AS task, arg_min(what, s_suppkey) AS what FROM (SELECT s_nationkey, s_suppkey, 'k' || s_suppkey AS task, c AS class,
  CASE WHEN s_suppkey % 4 = 0 THEN 'run' WHEN s_suppkey % 4 = 1 THEN 'bind' WHEN 'c' || (s_suppkey % 3) = c THEN 'run' WHEN 'c' || (s_suppkey % 3) IN ('c0', 'c1') THEN 'skip' ELSE 'rebind' END AS what FROM supplier, (SELECT unnest(['c0', 'c1']) AS c)) WHERE what <> 'skip' GROUP BY 1, 2"""
)
def next_tasks(spark, d):
    key = F.col("s_suppkey")
    s = v.read(spark, d, "supplier")
    queue = s.select(F.col("s_nationkey").alias("search_id"), key.alias("ord"), F.concat(F.lit("k"), key.cast("string")).alias("task"), F.when(key % 4 != 0, key).alias("chain"))
    chains = s.where(key % 4 > 1).select(key.alias("chain"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("bound"))
    both = F.array(F.lit("c0"), F.lit("c1"))
    workers = s.select(F.col("s_nationkey").alias("search_id")).distinct().select("search_id", F.explode(both).alias("class"), both.alias("present"))
    return placement.next_tasks(queue, chains, workers)


@_query(
    """ SELECT ord, name, CAST(slot - 1 AS INTEGER) AS slot, dest[slot] AS destination FROM (SELECT o_orderkey AS ord, 'n' || (o_orderkey % 30) AS name, CASE WHEN o_orderkey % 30 < 10 THEN [CASE WHEN o_orderkey % 30 % 2 = 0 THEN 'a' || (o_orderkey % 30) END] WHEN o_orderkey % 30 < 20 THEN ['x' || (o_orderkey % 30), 'y' || (o_orderkey % 30)] ELSE list_resize(CAST([] AS VARCHAR[]), o_orderkey % 30 % 3 + 1) END AS dest FROM orders) t, range(1, 4) r(slot) WHERE slot <= len(dest)"""
)
def fleet_expansion(spark, d):
    names = spark.range(30).select(F.col("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    hosts = names.where("id < 10").select("name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("a"), F.col("id").cast("string"))).alias("address"))
    spots = F.array(*[F.concat(F.lit(c), F.col("id").cast("string")) for c in "xy"])
    classes = names.where("id >= 10").select("name", F.when(F.col("id") < 20, spots).alias("addresses"), F.when(F.col("id") >= 20, F.col("id") % 3 + 1).cast("int").alias("count"))
    key = F.col("o_orderkey")
    members = v.read(spark, d, "orders").select(key.alias("ord"), F.concat(F.lit("n"), (key % 30).cast("string")).alias("name"))
    return placement.expand_fleet(members, hosts, classes)


@_query(f""" SELECT o_orderkey AS i, CAST(1000 AS BIGINT) AS step, CASE WHEN o_orderkey % 7 > 0 THEN CAST((18446744073709551615::HUGEINT - o_orderkey + (o_orderkey % 7) * 1000) % {_U} AS DECIMAL(20,0)) END AS acc FROM orders""")
def stepped(spark, d):
    key = F.col("o_orderkey")
    seed = F.lit(fn.U64).cast("decimal(20,0)") - key.cast("decimal(18,0)")
    return placement.stepped(v.read(spark, d, "orders").select(key.alias("i"), seed.cast("decimal(20,0)").alias("seed"), (key % 7).alias("increment")), 1000)


@_query(" SELECT x AS search_id, 'p' || (x % 3) AS digest, 'p' || (x % 2) AS bound FROM range(60) t(x) WHERE x % 3 <> x % 2")
def refused_programs(spark, d):
    rows = spark.range(60)
    named = lambda n: F.concat(F.lit("p"), (F.col("id") % n).cast("string")).alias("digest")
    return placement.refused_programs(rows.select(F.col("id").alias("search_id"), named(2)), rows.select(F.col("id").alias("search_id"), named(3)))


# ---- the store on disk, reports and supervision


def _forms(spark, d):
    """Loose objects are orders' keys but every third, packed ones those of even keys, by their hashes."""
    o = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"), F.col("o_orderkey").cast("string").cast("binary").alias("bytes"))
    return o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("pack", F.col("k") % 5)


_OBJECTS = "o AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders)"


@_query(" SELECT DISTINCT hash FROM o WHERE k % 3 <> 0 OR k % 2 = 0", _OBJECTS)
def held_objects(spark, d):
    return objects.held_objects(*_forms(spark, d))


@_query(" SELECT hash, k % 3 <> 0 OR k % 2 = 0 AS present FROM o", _OBJECTS)
def object_presence(spark, d):
    loose, packed = _forms(spark, d)
    every = v.read(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"))
    return objects.present(every, loose, packed)


@_query(" SELECT hash, CAST(k AS VARCHAR) AS text FROM o WHERE k % 7 = 2 AND (k % 3 <> 0 OR k % 2 = 0)", _OBJECTS)
def object_read(spark, d):
    loose, packed = _forms(spark, d)
    asked = loose.select("k", "hash").unionByName(packed.select("k", "hash")).where("k % 7 = 2").select("hash")
    return objects.get(asked, loose, packed).select("hash", F.col("bytes").cast("string").alias("text"))


@_query(" SELECT task_key, record_hash FROM manifests", v.STORE)
def task_index(spark, d):
    return objects.task_index(v.manifests(spark, d))


@_query(
    " SELECT * FROM (SELECT p_partkey % 50 AS pack, p_partkey AS position, CASE WHEN lag(p_type) OVER w >= p_type THEN 'not ascending' WHEN p_size % 3 <> coalesce(lag(p_size % 3 + p_size % 2) OVER w, 0) THEN 'gap or overlap' END AS fault FROM part WINDOW w AS (PARTITION BY p_partkey % 50 ORDER BY p_partkey)) WHERE fault IS NOT NULL"
)
def pack_faults(spark, d):
    size = F.col("p_size").cast("long")
    return objects.pack_faults(v.read(spark, d, "part").select((F.col("p_partkey") % 50).alias("pack"), F.col("p_partkey").alias("position"), F.col("p_type").alias("hash"), (size % 3).alias("start"), (size % 2).alias("length")))


@_query(
    f"""WITH RECURSIVE a AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, CAST(o_custkey AS BIGINT) AS size FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT * FROM a WHERE k % 2 <> 0),
o AS (SELECT size, substr(hash, 1, 1) AS shard, row_number() OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash) AS n FROM f),
w AS (SELECT shard, n, size AS total, 1 AS fresh FROM o WHERE n = 1 UNION ALL SELECT o.shard, o.n, CASE WHEN w.total + o.size > 20000 THEN o.size ELSE w.total + o.size END, CASE WHEN w.total + o.size > 20000 THEN 1 ELSE 0 END FROM w JOIN o ON o.shard = w.shard AND o.n = w.n + 1)
SELECT (SELECT count(*) FROM f) AS objects_packed, (SELECT CAST(sum(fresh) AS BIGINT) FROM w) AS packs_written, (SELECT count(*) FROM a) AS loose_removed, (SELECT CAST(sum(size) AS BIGINT) FROM f) AS raw_bytes, (SELECT CAST(sum(least(size, 700)) AS BIGINT) FROM f) AS stored_bytes"""
)
def pack_report(spark, d):
    o = v.read(spark, d, "orders")
    size = F.col("o_custkey").cast("long")
    rows = o.select(F.col("o_orderkey").alias("k"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"), size.alias("size"), F.least(size, F.lit(700)).alias("stored"))
    return objects.compaction(rows.where("k % 3 <> 0").drop("k"), rows.where("k % 2 = 0").select("hash"), 20_000)[1]


@_query(
    _LIVE
    + """, doomed AS (SELECT object FROM held WHERE object NOT IN (SELECT object FROM live)) SELECT (SELECT count(*) FROM doomed) AS objects_removed, (SELECT count(*) FROM manifests WHERE record_hash IN (SELECT object FROM doomed)) AS index_entries_removed,
  (SELECT count(DISTINCT CAST(substr(object, 2) AS BIGINT) % 40) FROM doomed WHERE starts_with(object, 'p')) AS packs_rewritten, (SELECT count(*) FROM searches WHERE NOT finalized) AS searches_removed""",
    v.STORE,
)
def gc_report(spark, d):
    held = _held(spark, d)
    packed = held.where(F.col("object").startswith("p")).select((F.substring("object", 2, 20).cast("long") % 40).alias("pack"), F.col("object").alias("hash"))
    return objects.gc_report(held, v.searches(spark, d), v.manifests(spark, d), v.references(spark, d), packed)


@_query(" SELECT count(*) FILTER (k % 3 <> 0 AND k % 2 <> 0) AS records_sent, count(*) FILTER (k % 2 = 0 AND k % 3 = 0) AS records_received, count(*) FILTER (k % 5 <> 0 AND k % 7 <> 0) AS objects_sent, count(*) FILTER (k % 7 = 0 AND k % 5 = 0) AS objects_received FROM o", _OBJECTS)
def sync_report(spark, d):
    k = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    rows = lambda test, name: k.where(test).select(F.col("k").alias(name))
    return objects.sync_report(rows("k % 3 <> 0", "task_key"), rows("k % 2 = 0", "task_key"), rows("k % 5 <> 0", "object"), rows("k % 7 = 0", "object"))


@_query(" SELECT 'record' AS what, CAST(task_key AS VARCHAR) AS id FROM manifests WHERE task_key % 3 = 0 UNION ALL SELECT 'object', object FROM held WHERE CAST(regexp_extract(object, '[0-9]+') AS BIGINT) % 11 = 0".replace(" SELECT 'record'", _LIVE + " SELECT 'record'", 1), v.STORE)
def sync_offer(spark, d):
    """What a side advertises of the keys and objects that it is asked for."""
    m, held = v.manifests(spark, d), _held(spark, d)
    asked = m.where("task_key % 3 = 0").select("task_key").unionByName(spark.range(5).select((-F.col("id") - 1).alias("task_key")))
    named = held.where(F.regexp_extract("object", "[0-9]+", 0).cast("long") % 11 == 0).unionByName(spark.range(5).select(F.concat(F.lit("none"), F.col("id").cast("string")).alias("object")))
    records, offered = objects.offered(asked, m, named, held)
    return records.select(F.lit("record").alias("what"), F.col("task_key").cast("string").alias("id")).unionByName(offered.select(F.lit("object").alias("what"), F.col("object").alias("id")))


@_query(" SELECT o_orderkey AS task_key, 'r' || o_orderkey AS record FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def synchronized(spark, d):
    """The union of two stores that agree where they overlap."""
    o = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("task_key"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record"))
    return store.synchronized(o.where("task_key % 3 <> 0"), o.where("task_key % 2 = 0"))


@_query(
    """ SELECT o_orderkey AS task_key, part, object FROM (SELECT o_orderkey, unnest(['spec', 'params', 'environment']) AS part, unnest(['s' || (o_custkey % 50), 'q' || (o_orderkey % 20), 'e' || (o_orderkey % 3)]) AS object FROM orders) WHERE object IN ('s7', 'q3', 'q4')"""
)
def replica_faults(spark, d):
    o = v.read(spark, d, "orders")
    name = lambda c, key, n: F.concat(F.lit(c), (F.col(key) % n).cast("string"))
    records = o.select(F.col("o_orderkey").alias("task_key"), name("s", "o_custkey", 50).alias("spec"), name("q", "o_orderkey", 20).alias("params"), name("e", "o_orderkey", 3).alias("environment"))
    every = records.select(F.explode(F.array("spec", "params", "environment")).alias("object")).distinct()
    return objects.replica_faults(records, every.where(~F.col("object").isin("s7", "q3", "q4")))


@_query(" SELECT o_custkey AS search_id, o_orderkey AS task_key, 'r' || o_orderkey AS record_hash FROM orders WHERE o_orderstatus = 'F'")
def finalized_manifest(spark, d):
    m = v.manifests(spark, d)
    closed = v.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("task_key"))
    return store.finalize(closed, m).select("search_id", "task_key", "record_hash")


@_query(" SELECT l_partkey % 40 AS class, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def first_seen_classes(spark, d):
    rows = v.read(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") % 40).alias("class"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return store.insertion_distinct(rows, "class", "ord")


@_query(" SELECT search_id, worker, seq FROM (SELECT *, row_number() OVER (PARTITION BY search_id, worker ORDER BY seq) AS n FROM journal WHERE event = 'worker_bound') WHERE n % 3 = 0", v.JOURNAL)
def checkpoint_saves(spark, d):
    rows = v.journal(spark, d).where("event = 'worker_bound'").select("search_id", "worker", "seq", "ts_ms", F.lit(0).cast("long").alias("start_ms"))
    return live.saves(rows, ["search_id", "worker"], 3, None).select("search_id", "worker", "seq")


@_query(" SELECT ord, destination FROM (SELECT o_orderkey AS ord, 'a' || (o_custkey % 400) AS destination, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey % 5 <> 0) WHERE n > 1")
def repeated_destinations(spark, d):
    o = v.read(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("ord"), F.lit(0).alias("slot"), F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("a"), (F.col("o_custkey") % 400).cast("string"))).alias("destination"))
    return placement.repeated_destinations(rows).select("ord", "destination")


@_query(
    """ SELECT prefix, CASE WHEN prefix = '' THEN 'empty prefix' WHEN n = 1 THEN 'found' WHEN n = 0 THEN 'no search' ELSE 'ambiguous: ' || ids END AS resolution, CASE WHEN n = 1 THEN ids END AS search_id FROM (
  SELECT prefix, count(s) AS n, string_agg(s, ', ' ORDER BY s) AS ids FROM (SELECT unnest(['', '1', '12', '1234567', 'x'] ) AS prefix) LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS s FROM orders) ON prefix <> '' AND starts_with(s, prefix) GROUP BY 1)"""
)
def search_prefixes(spark, d):
    registry = v.searches(spark, d).select(F.col("search_id").cast("string").alias("search_id"))
    return journal.search_prefix(registry, spark.range(1).select(F.explode(F.array(*map(F.lit, ("", "1", "12", "1234567", "x")))).alias("prefix")))


@_query(" SELECT tag, started_ms, cost_micro_usd FROM spend UNION ALL SELECT tag, created_ms, CAST(7 AS DECIMAL(20,0)) FROM instances WHERE st <> 'F' AND CAST(substr(tag, 2) AS BIGINT) % 4 = 0", v.INSTANCES)
def spend_close_out(spark, d):
    """Closing all of every fourth rental, those that are closed already too."""
    rows, spend = v.instances(spark, d), v.spend(spark, d)
    again = rows.where(F.substring("tag", 2, 20).cast("long") % 4 == 0)
    closed = again.select("tag", "provider", "owner", "price_micro_usd_hour", F.col("created_ms").alias("started_ms"), F.col("created_ms").alias("ended_ms"), F.lit(7).cast("decimal(20,0)").alias("cost_micro_usd"))
    return ledger.close_out(spend, closed.unionByName(closed)).select("tag", "started_ms", "cost_micro_usd")


@_query(" SELECT tag FROM instances WHERE state <> 'intent'", v.INSTANCES)
def instances_removed(spark, d):
    rows = v.instances(spark, d)
    return ledger.remove(rows, rows.where("state = 'intent'").unionByName(rows.limit(0)), ["tag"]).select("tag")


@_query(" SELECT o_custkey AS search_id, o_orderkey AS task_key, CASE WHEN k = 1 AND o_orderkey % 10 <> 0 THEN 'c' || o_orderkey END AS payload FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)")
def checkpoint_slots(spark, d):
    """One slot a search, written by each of its tasks in turn; one in ten frames is torn."""
    o = v.read(spark, d, "orders").select(F.col("o_custkey").alias("search_id"), F.lit(0).alias("slot"), F.col("o_orderkey").alias("task_key"))
    torn = F.col("task_key") % 10 == 0
    writes = o.select("search_id", "slot", F.when(~torn, F.col("task_key")).alias("owner"), F.when(~torn, F.concat(F.lit("c"), F.col("task_key").cast("string"))).alias("payload"), F.col("task_key").alias("at"))
    slots = objects.save_slots(writes.drop("at").limit(0), writes, ["search_id", "slot"], "at")
    return objects.load_checkpoints(slots, o).select("search_id", "task_key", "payload")


@_query(" SELECT DISTINCT 'd' || l_orderkey AS digest, unnest(['d' || l_orderkey, 'p' || l_partkey]) AS object FROM lineitem")
def payload_closure(spark, d):
    rows = v.read(spark, d, "lineitem").select(F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("digest"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object"))
    return objects.payload_closure(rows)


@_query(f", {_STATE} SELECT search_id, state, state <> 'in_progress' OR CAST(search_id AS INTEGER) % 2 = 0 AS over, CASE WHEN state <> 'in_progress' OR CAST(search_id AS INTEGER) % 2 = 0 THEN CASE state WHEN 'failed' THEN 1 WHEN 'interrupted' THEN 2 ELSE 0 END END AS exit FROM state", v.JOURNAL)
def follow_ends(spark, d):
    """Odd searches are held by somebody."""
    log = v.journal(spark, d)
    held = log.select("search_id").distinct().where(F.col("search_id").cast("int") % 2 == 1).withColumn("holder", F.lit("host"))
    return feed.terminations(log, held)


@_query(f", {_CHARGED}, b AS (SELECT owner, CASE WHEN total >= {_CAP} THEN 'spend' WHEN {v.NOW_MS} >= first_ms + {_WALL} THEN 'wall_clock' ELSE 'within' END AS verdict FROM report) SELECT i.owner, i.tag, CASE WHEN verdict <> 'within' THEN 'wind down: ' || verdict WHEN CAST(substr(i.tag, 2) AS BIGINT) % 4 = 0 THEN 'replace' ELSE 'keep' END AS action FROM instances i JOIN b USING (owner) WHERE state = 'live' AND st <> 'F'", v.INSTANCES)
def heartbeat_actions(spark, d):
    rows = v.instances(spark, d)
    polled = rows.where("instance is not null").select("instance", F.when(F.substring("tag", 2, 20).cast("long") % 4 == 0, "gone").otherwise("ready").alias("status"))
    return supervise.heartbeat(rows, v.spend(spark, d), polled, v.NOW_MS, _CAP, _WALL)
