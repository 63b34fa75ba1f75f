"""Queries over the event log. Each takes the log as a DataFrame and returns a DataFrame.

The only order is the append order ``seq`` within a search; stamps may go backwards. Windows are
partitioned by search and task, worker or device where the question allows it; those that need a
whole search say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.functions.scalars import valid_key

#: Events that concern one task. A diagnostic may name a task and is still not one of them.
LIFECYCLE = ("queued", "leased", "committed", "failed", "retried", "rejected", "faulted", "lease_expired", "checkpoint_degraded", "checkpointed")
TERMINAL = ("committed", "failed", "rejected", "faulted")
SEARCH_LEVEL = ("search_started", "search_finalized", "search_failed", "search_interrupted")
#: Events that the minimal narration leaves out.
QUIET = ("renting", "awaiting_machine", "sending_search", "installing_program", "starting_search", "instance_online", "leased", "checkpointed")


def _is(*events: str) -> Column:
    return F.col("event").isin(*events)


def _n(event: str) -> Column:
    return F.count(F.when(_is(event), 1))


def lifecycle_task(journal: DataFrame) -> DataFrame:
    """The log with ``lifecycle_task``: the task of a task-scoped event, else null."""
    return journal.withColumn("lifecycle_task", F.when(_is(*LIFECYCLE), F.col("task")))


def status_counts(journal: DataFrame) -> DataFrame:
    """One row a search: counters over the whole log, latest task count, and the deciding state."""
    last = F.max_by(F.struct("event", "task", "reason"), F.when(_is(*SEARCH_LEVEL), F.col("seq")))
    counted = journal.groupBy("search_id").agg(
        F.coalesce(F.max_by("tasks", F.when(_is("search_started"), F.col("seq"))), F.lit(0)).alias("tasks"),
        *[_n(e).alias(c) for e, c in (("committed", "committed"), ("retried", "retried"), ("rejected", "rejected"), ("faulted", "faulted"), ("lease_expired", "lease_expired"), ("checkpoint_degraded", "checkpoint_degraded"), ("chain_rebound", "rebound_chains"))],
        last.alias("l"),
    )
    state = F.when(F.col("l.event") == "search_finalized", "finalized").when(F.col("l.event") == "search_failed", "failed").when(F.col("l.event") == "search_interrupted", "interrupted").otherwise("in_progress")
    failed = F.col("l.event") == "search_failed"
    return counted.select("*", state.alias("state"), F.when(failed, F.col("l.task")).alias("failed_task"), F.when(failed, F.col("l.reason")).alias("failed_reason")).drop("l")


def composition_label(device: Column, host: Column) -> Column:
    return F.when(host == "", device).otherwise(F.concat_ws(" @ ", device, host))


def status_composition(journal: DataFrame) -> DataFrame:
    """Commits per device label, each credited to the device its worker reported *by then*.

    Presumes that a task is leased by one worker at a time: the commit counts if the last lease of
    its task is also the last lease of that worker, after the task's last outcome and the search's
    last start. ``runlode.streaming.status.fold_statuses`` has no such condition.
    """
    task = Window.partitionBy("search_id", "task").orderBy("seq")
    earlier = task.rowsBetween(Window.unboundedPreceding, -1)
    tasks = journal.where(_is("leased", *TERMINAL)).withColumn("tl", F.max(F.when(_is("leased"), F.col("seq"))).over(earlier)).withColumn("wk", F.max_by("worker", F.when(_is("leased"), F.col("seq"))).over(earlier)).withColumn("lt", F.max(F.when(_is(*TERMINAL), F.col("seq"))).over(earlier))
    commits = tasks.where(_is("committed") & F.col("tl").isNotNull()).select("search_id", "seq", F.col("wk").alias("worker"), "tl", "lt", F.lit("commit").alias("what"), F.lit(None).cast("string").alias("device"), F.lit(None).cast("string").alias("host"))
    others = journal.where(_is("leased", "worker_bound")).select("search_id", "seq", "worker", F.lit(None).cast("long").alias("tl"), F.lit(None).cast("long").alias("lt"), F.when(_is("leased"), "lease").otherwise("bound").alias("what"), "device", "host")
    worker = Window.partitionBy("search_id", "worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = others.unionByName(commits).withColumn("wl", F.max(F.when(F.col("what") == "lease", F.col("seq"))).over(worker)).withColumn("b", F.max_by(F.struct("device", "host"), F.when(F.col("what") == "bound", F.col("seq"))).over(worker))
    resets = journal.where(_is(*SEARCH_LEVEL)).select("search_id", F.col("seq").alias("rs"))
    held = seen.where("what = 'commit' and wl = tl and wl > coalesce(lt, -1)")
    starts = resets.groupBy("search_id").agg(F.array_sort(F.collect_list("rs")).alias("rs"))
    ok = held.join(starts, "search_id", "left").where(~F.coalesce(F.exists("rs", lambda r: (r > F.col("wl")) & (r < F.col("seq"))), F.lit(False)))
    return ok.where("b.device <> ''").select("search_id", composition_label(F.col("b.device"), F.col("b.host")).alias("label")).groupBy("search_id", "label").agg(F.count("*").alias("commits"))


def status_occupancy(journal: DataFrame) -> DataFrame:
    """(search_id, worker, task, attempt) of leases that are still open."""
    lease = F.when(_is("leased"), F.col("seq"))
    workers = journal.where(_is("leased")).groupBy("search_id", "worker").agg(F.max("seq").alias("wl"), F.max_by(F.struct("task", "attempt"), "seq").alias("x")).select("search_id", "worker", "wl", "x.*")
    ends = journal.where(_is("leased", *TERMINAL)).groupBy("search_id", "task").agg(F.max(F.when(_is(*TERMINAL), F.col("seq"))).alias("te"), F.max(lease).alias("tl"))
    resets = journal.where(_is(*SEARCH_LEVEL)).groupBy("search_id").agg(F.max("seq").alias("rs"))
    return workers.join(ends, ["search_id", "task"]).join(resets, "search_id", "left").where("wl > coalesce(te, -1) and wl > coalesce(rs, -1)").select("search_id", "worker", "task", "attempt")


def bindings(journal: DataFrame) -> DataFrame:
    """(search_id, worker, device, host): the last binding of each worker in the whole log."""
    return journal.where(_is("worker_bound")).groupBy("search_id", "worker").agg(F.max_by(F.struct("device", "host"), "seq").alias("b")).select("search_id", "worker", "b.*")


def with_bindings(rows: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows with the device and host of their worker, empty if it never reported."""
    return rows.join(bindings(journal), ["search_id", "worker"], "left").fillna("", ["device", "host"])


def task_attempts(journal: DataFrame) -> DataFrame:
    """One row for each lease: its worker and device, start, end, result, and whether it expired.

    Only the last attempt of a task can be closed, and once: the first outcome after its lease ends
    it, and an attempt that another lease supersedes stays in flight.
    """
    task = Window.partitionBy("search_id", "task").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = journal.where(_is("leased", "lease_expired", *TERMINAL)).withColumn("number", F.sum(_is("leased").cast("int")).over(task)).where("number > 0")
    ends = F.when(_is(*TERMINAL), F.col("seq"))
    leased = lambda c: F.max(F.when(_is("leased"), F.col(c)))
    attempts = rows.groupBy("search_id", "task", "number").agg(
        leased("worker").alias("worker"),
        leased("attempt").alias("attempt"),
        leased("ts_ms").alias("started_ms"),
        F.min_by("ts_ms", ends).alias("ended_ms"),
        F.coalesce(F.min_by("event", ends), F.lit("in_flight")).alias("result"),
        F.min_by("reason", ends).alias("reason"),
        F.min(ends).alias("end_seq"),
        F.min(F.when(_is("lease_expired"), F.col("seq"))).alias("expired_seq"),
    )
    expired = F.col("expired_seq").isNotNull() & (F.col("expired_seq") < F.coalesce("end_seq", F.lit((1 << 63) - 1)))
    return with_bindings(attempts.withColumn("lease_expired", expired), journal).select("search_id", "task", "number", "attempt", "worker", "device", "host", "started_ms", "ended_ms", "result", "reason", "lease_expired")


def task_outcomes(journal: DataFrame) -> DataFrame:
    """(search_id, task, queued_ms, outcome): the first queueing, and where the task stands now."""
    deciding = F.when(_is("leased", "committed", "rejected", "faulted"), F.col("seq"))
    state = F.max_by("event", deciding)
    outcome = F.when(state == "leased", "in_progress").otherwise(F.coalesce(state, F.lit("queued")))
    return journal.where(_is(*LIFECYCLE)).groupBy("search_id", "task").agg(F.min_by("ts_ms", F.when(_is("queued"), F.col("seq"))).alias("queued_ms"), outcome.alias("outcome"))


def failed_tasks(journal: DataFrame) -> DataFrame:
    """Tasks whose outcome is rejected or faulted, by task."""
    return task_outcomes(journal).where(F.col("outcome").isin("rejected", "faulted")).orderBy("search_id", "task")


def prefix_resolution(journal: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each (search_id, prefix): the one lifecycle task that starts with it, or how it fails.

    resolution is "found", "no task" or "ambiguous: N". The prefixes are the stated query set.
    """
    tasks = journal.where(_is(*LIFECYCLE)).select("search_id", "task").distinct()
    hits = prefixes.join(tasks, (prefixes["search_id"] == tasks["search_id"]) & tasks["task"].startswith(prefixes["prefix"]), "left").groupBy(prefixes["search_id"], "prefix").agg(F.count("task").alias("n"), F.min("task").alias("task"))
    told = F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "no task").otherwise(F.concat(F.lit("ambiguous: "), F.col("n").cast("string")))
    return hits.select("search_id", "prefix", told.alias("resolution"), F.when(F.col("n") == 1, F.col("task")).alias("task"))


def latest_session(journal: DataFrame) -> DataFrame:
    """Rows from each search's last start on; the whole log of a search that never started.

    The start's seq is an aggregate a search, joined back, so no search is gathered in one task.
    """
    start = journal.groupBy("search_id").agg(F.coalesce(F.max(F.when(_is("search_started"), F.col("seq"))), F.min("seq")).alias("session_seq"))
    return journal.join(start, "search_id").where(F.col("seq") >= F.col("session_seq"))


def session_bounds(journal: DataFrame) -> DataFrame:
    """First and last stamp of the latest session in file order, its tasks and commits, and all commits."""
    every = journal.groupBy("search_id").agg(_n("committed").alias("committed"))
    now = latest_session(journal).groupBy("search_id").agg(F.min_by("ts_ms", "seq").alias("start_ms"), F.max_by("ts_ms", "seq").alias("end_ms"), F.coalesce(F.max_by("tasks", F.when(_is("search_started"), F.col("seq"))), F.lit(0)).alias("tasks"), _n("committed").alias("session_committed"))
    return now.join(every, "search_id")


def session_retries(journal: DataFrame) -> DataFrame:
    """Retries, retried tasks, failed attempts and all attempts of the latest session."""
    return latest_session(journal).groupBy("search_id").agg(_n("retried").alias("retries"), F.countDistinct(F.when(_is("retried"), F.col("task"))).alias("retried_tasks"), F.count(F.when(_is("failed", "rejected", "faulted"), 1)).alias("failed_attempts"), _n("leased").alias("total_attempts"))


def lease_spans(journal: DataFrame) -> DataFrame:
    """(search_id, worker, start_ms, end_ms, committed): leases of the latest session with their ends.

    A lease ends at the task's next outcome, or with the session; one that another lease of the task
    replaces first is dropped. An end before the start makes an empty span.
    """
    session = latest_session(journal)
    ends = session.groupBy("search_id").agg(F.max_by("ts_ms", "seq").alias("session_end"))
    task = Window.partitionBy("search_id", "task").orderBy("seq")
    rows = session.where(_is("leased", *TERMINAL)).withColumn("nxt", F.lead(F.struct("event", "ts_ms")).over(task)).where(_is("leased") & (F.col("nxt").isNull() | (F.col("nxt.event") != "leased")))
    return rows.join(ends, "search_id").select("search_id", "worker", F.col("ts_ms").alias("start_ms"), F.greatest("ts_ms", F.coalesce("nxt.ts_ms", "session_end")).alias("end_ms"), F.coalesce(F.col("nxt.event") == "committed", F.lit(False)).alias("committed"))


def worker_metrics(journal: DataFrame) -> DataFrame:
    """Per worker of the latest session: device, first bind, respawns, busy and life spans, commits, attempts."""
    session = latest_session(journal)
    bounds = session.groupBy("search_id").agg(F.min_by("ts_ms", "seq").alias("start"), F.max_by("ts_ms", "seq").alias("end"))
    seen = session.where(_is("worker_bound", "leased")).groupBy("search_id", "worker").agg(F.min(F.when(_is("worker_bound"), F.col("ts_ms"))).alias("bind"), _n("worker_bound").alias("bindings"), _n("leased").alias("attempts"))
    spans = lease_spans(journal).groupBy("search_id", "worker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("busy"), F.count(F.when(F.col("committed"), 1)).alias("commits"))
    joined = with_bindings(seen.join(spans, ["search_id", "worker"], "left").join(bounds, "search_id"), journal)
    first = F.coalesce("bind", "start")
    zero = F.lit(0).cast("long")
    return joined.select("search_id", "worker", "device", "host", first.alias("first_bind_ms"), F.greatest(zero, F.col("bindings") - 1).alias("respawns"), F.coalesce("busy", zero).alias("busy_ms"), F.greatest(zero, F.col("end") - first).alias("lifespan_ms"), F.coalesce("commits", zero).alias("commits"), "attempts")


def latest_stats(journal: DataFrame) -> DataFrame:
    """(search_id, task, stats): what the latest commit of each task measured."""
    return journal.where(_is("committed")).groupBy("search_id", "task").agg(F.max_by("stats", "seq").alias("stats"))


def stats_histogram(journal: DataFrame) -> DataFrame:
    """How many tasks have each set of latest stats; most first, then by the stats."""
    return latest_stats(journal).groupBy("search_id", "stats").agg(F.count("*").alias("tasks")).orderBy("search_id", F.desc("tasks"), "stats")


def running_commits(journal: DataFrame, block: int = 100_000) -> DataFrame:
    """(search_id, seq, done, tasks) at each commit: the session's restored count plus commits so far.

    Counts run within blocks of ``block`` positions and over the blocks' totals, so a search's log is
    dealt over as many tasks as it has blocks. A start carries what it restored less the commits
    before it; adding all commits up to a row to its last start's figure gives the count.
    """
    committed = F.when(_is("committed"), 1).otherwise(0).cast("long")
    rows = journal.where(_is("search_started", "committed")).select("search_id", "seq", "event", "tasks", "restored", F.floor(F.col("seq") / block).alias("block"), committed.alias("c"))
    inside = Window.partitionBy("search_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchor = F.struct("seq", (F.coalesce("restored", F.lit(0)) - F.col("n")).alias("less"), F.coalesce("tasks", F.lit(0)).alias("tasks"))
    counted = rows.withColumn("n", F.sum("c").over(inside)).withColumn("a", F.max(F.when(_is("search_started"), anchor)).over(inside))
    blocks = counted.groupBy("search_id", "block").agg(F.sum("c").alias("n"), F.max("a").alias("a"))
    before = Window.partitionBy("search_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("own", F.struct("a.seq", (F.col("a.less") - F.col("base")).alias("less"), "a.tasks"))
    carried = totals.withColumn("last", F.max(F.when(F.col("a").isNotNull(), F.col("own"))).over(before)).select("search_id", "block", "base", "last")
    joined = counted.where(_is("committed")).join(carried, ["search_id", "block"])
    less = F.coalesce(F.col("a.less") - F.col("base"), F.col("last.less"), F.lit(0))
    return joined.select("search_id", "seq", (F.col("base") + F.col("n") + less).alias("done"), F.coalesce("a.tasks", "last.tasks", F.lit(0)).alias("tasks"))


def journaled_keys(journal: DataFrame) -> DataFrame:
    """Distinct lifecycle tasks of each search, sorted; a task that is no key in hex is skipped."""
    return journal.where(_is(*LIFECYCLE) & valid_key(F.col("task"))).select("search_id", "task").distinct().orderBy("search_id", "task")


def driver_changes(journal: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(search_id, seq, host, device, from_driver, to_driver) where a device reports another driver.

    baseline: (search_id, host, device, driver) last known before this log.
    """
    rows = journal.where(_is("worker_bound") & F.col("driver").isNotNull() & (F.col("driver") != "")).select("search_id", "seq", "host", "device", "driver")
    if baseline is not None:
        rows = rows.unionByName(baseline.withColumn("seq", F.lit(-1).cast("long")))
    device = Window.partitionBy("search_id", "host", "device").orderBy("seq")
    return rows.withColumn("from_driver", F.lag("driver").over(device)).where("seq >= 0 and from_driver <> driver").select("search_id", "seq", "host", "device", "from_driver", F.col("driver").alias("to_driver"))


def last_program(journal: DataFrame) -> DataFrame:
    """(search_id, digest): the last program a session was bound to."""
    return journal.where(_is("program_bound")).groupBy("search_id").agg(F.max_by("digest", "seq").alias("digest"))


def narrated(journal: DataFrame) -> DataFrame:
    """Events that the minimal narration tells."""
    return journal.where(~_is(*QUIET))


def last_lines(journal: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` events of each search, the ring buffer of a live view."""
    late = Window.partitionBy("search_id").orderBy(F.desc("seq"))
    return journal.withColumn("back", F.row_number().over(late)).where(F.col("back") <= n).drop("back")


def chart_buckets(bounds: DataFrame, columns: int = 48) -> DataFrame:
    """(search_id, column, from_ms, to_ms): integer edges of the session's chart."""
    edge = lambda c: F.expr(f"start_ms + greatest(0L, end_ms - start_ms) * ({c}) div {columns}")
    return bounds.select("search_id", "start_ms", "end_ms", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")).select("search_id", "column", edge("column").alias("from_ms"), edge("column + 1").alias("to_ms"))


def chart_column(stamp: Column, columns: int = 48) -> Column:
    """The last column whose first edge is at the stamp or before it, or the first, by arithmetic on its session.

    An edge start + span * c div n is at most start + d exactly if c n-ths of the span are below d + 1.
    """
    span = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms"))
    late = F.greatest(F.lit(0).cast("long"), stamp - F.col("start_ms") + 1) * columns
    at = F.when(span > 0, F.floor((late + span - 1) / span) - 1).when(stamp >= F.col("start_ms"), columns - 1).otherwise(0)
    return F.least(F.lit(columns - 1), F.greatest(F.lit(0), at)).cast("int")


def commit_sparkline(journal: DataFrame, columns: int = 48) -> DataFrame:
    """(search_id, column, commits, level): commits per chart column, scaled to eight levels."""
    bounds = session_bounds(journal)
    buckets = chart_buckets(bounds, columns)
    commits = latest_session(journal).where(_is("committed")).select("search_id", "ts_ms")
    placed = commits.join(bounds.select("search_id", "start_ms", "end_ms"), "search_id").withColumn("column", chart_column(F.col("ts_ms"), columns))
    counted = buckets.join(placed.groupBy("search_id", "column").agg(F.count("*").alias("commits")), ["search_id", "column"], "left").fillna(0, ["commits"])
    busiest = F.max("commits").over(Window.partitionBy("search_id"))
    return counted.select("search_id", "column", "commits", F.when(F.col("commits") > 0, F.ceil(F.col("commits") * 8 / busiest)).otherwise(0).cast("long").alias("level"))


def occupancy_buckets(journal: DataFrame, columns: int = 48) -> DataFrame:
    """(search_id, worker, column, busy_ms, glyph): blank before the worker's bind, full from half busy on."""
    bounds = session_bounds(journal)
    buckets = chart_buckets(bounds, columns)
    workers = worker_metrics(journal).select("search_id", "worker", "first_bind_ms")
    cells = workers.join(buckets, "search_id")
    spans = lease_spans(journal).where("end_ms > start_ms").select("search_id", "worker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    # A span becomes the columns that it reaches over, and no others.
    reach = F.sequence(chart_column(F.col("s"), columns), chart_column(F.col("e") - 1, columns))
    cut = spans.join(bounds.select("search_id", "start_ms", "end_ms"), "search_id").select("search_id", "worker", "s", "e", F.explode(reach).alias("column"))
    edges = buckets.select("search_id", "column", "from_ms", "to_ms")
    met = cut.join(edges, ["search_id", "column"]).select("search_id", "worker", "column", "from_ms", "to_ms", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")).where("start_ms < to_ms and end_ms > from_ms").groupBy("search_id", "worker", "column").agg(F.sum(F.least("end_ms", "to_ms") - F.greatest("start_ms", "from_ms")).alias("busy_ms"))
    drawn = F.when(F.col("to_ms") <= F.col("first_bind_ms"), "blank").when((F.col("to_ms") > F.col("from_ms")) & (F.col("busy_ms") * 2 >= F.col("to_ms") - F.col("from_ms")), "full").otherwise("light")
    return cells.join(met, ["search_id", "worker", "column"], "left").fillna(0, ["busy_ms"]).select("search_id", "worker", "column", "busy_ms", drawn.alias("glyph"))


def search_summaries(registry: DataFrame, journal: DataFrame) -> DataFrame:
    """A row for each registered search, by id; one without a log is in progress with zeros."""
    known = registry.select("search_id").join(status_counts(journal), "search_id", "left")
    return known.fillna(0, ["tasks", "committed", "rejected", "faulted"]).fillna("in_progress", ["state"]).select("search_id", "tasks", "committed", "rejected", "faulted", "state").orderBy("search_id")


def search_prefix(registry: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, resolution, search_id): the one registered search that starts with each prefix, or how it fails.

    The empty prefix addresses nothing. An ambiguous one names all that it matches, in order; the
    prefixes are the stated query set.
    """
    asked, known = prefixes.select("prefix").distinct(), registry.select("search_id").distinct()
    hits = asked.join(known, (asked["prefix"] != "") & known["search_id"].startswith(asked["prefix"]), "left").groupBy("prefix").agg(F.count("search_id").alias("n"), F.array_sort(F.collect_list("search_id")).alias("ids"))
    told = F.when(F.col("prefix") == "", "empty prefix").when(F.col("n") == 1, "found").when(F.col("n") == 0, "no search").otherwise(F.concat(F.lit("ambiguous: "), F.array_join("ids", ", ")))
    return hits.select("prefix", told.alias("resolution"), F.when(F.col("n") == 1, F.col("ids")[0]).alias("search_id"))


class NoStore(ValueError):
    """The store does not exist, so no search was ever run there."""


class NeverStarted(ValueError):
    """The store is there and the search never wrote an event."""


def log_of(journal: DataFrame | None, search_id: str) -> DataFrame:
    """The log of one search. journal: all logs, None if there is no store; each absence is its own error."""
    if journal is None:
        raise NoStore("the store does not exist")
    own = journal.where(F.col("search_id") == search_id)
    if own.isEmpty():
        raise NeverStarted(f"search {search_id} was never started in this store")
    return own


def seeded_status(journal: DataFrame | None, search_ids: DataFrame) -> DataFrame:
    """Status counts of the searches, zeros and in progress where there is no log or no store."""
    if journal is None:
        journal = search_ids.select("search_id").limit(0).selectExpr("search_id", "0L seq", "'' event", "'' task", "'' reason", "0L tasks")
    counts = ["tasks", "committed", "retried", "rejected", "faulted", "lease_expired", "checkpoint_degraded", "rebound_chains"]
    known = search_ids.select("search_id").distinct().join(status_counts(journal), "search_id", "left")
    return known.fillna(0, counts).fillna("in_progress", ["state"])
