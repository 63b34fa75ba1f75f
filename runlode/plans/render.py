"""Lines and blocks of text from small results, and the narration of events as a column."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlode.functions.scalars import dollars, short
from runlode.operators.journal import QUIET, commit_sparkline, occupancy_buckets, running_commits, session_bounds, session_retries, worker_metrics

# Fixed formats: what each event says. Fields in braces are the event's; {done} and {all} the running
# counts. Events that are not listed, and diagnostics that only inform, say nothing.
SAYS = {
    "committed": "committed {done}/{all}  {task}",
    "retried": "retrying {task} (attempt {next_attempt})",
    "rejected": "rejected {task}: {reason}",
    "failed": "failed {task} (attempt {attempt}): {reason}",
    "faulted": "fault {task}: {error}",
    "lease_expired": "lease expired {task} ({elapsed_ms} ms)",
    "checkpoint_degraded": "checkpoint degraded {task}: {error}",
    "leased": "task {task} started (worker {worker})",
    "checkpointed": "task {task} checkpointed (worker {worker})",
    "search_finalized": "finalized: {restored} tasks committed",
    "search_failed": "search failed on {task}: {reason}",
    "search_interrupted": "interrupted: store resumable, run the search again to continue",
    "chain_rebound": "chain {chain} rebound: {from} is absent, continuing on {to}",
    "starting_search": "starting the search",
    "acquisition_abandoned": "acquisition abandoned: {released} machine(s) released, none of them left running",
    "instance_lost": "instance lost {instance}",
    "instance_replaced": "instance replaced {from} with {to}",
    "budget_spend_exhausted": "budget exhausted: spent {accrued_microusd} of {cap_microusd}, winding down",
    "budget_wall_clock_exhausted": "budget exhausted: rental deadline (epoch ms {deadline_ms}) passed, winding down",
}
_SHORT = ("task", "instance")
_MONEY = ("accrued_microusd", "cap_microusd")


def _filled(template: str, columns: set[str], shorten: tuple[str, ...]) -> Column:
    out: list[Column] = []
    for part in template.split("{"):
        name, closed, rest = part.partition("}")
        if not closed:
            out.append(F.lit(part))
            continue
        value = F.col(f"`{name}`").cast("string") if name in columns else F.lit("")
        if name in _MONEY and name in columns:
            value = dollars(F.col(name))
        out += [F.coalesce(short(value) if name in shorten else value, F.lit("")), F.lit(rest)]
    return F.concat(*out)


def narrate(journal: DataFrame, minimal: bool = False) -> DataFrame:
    """(search_id, seq, line): what each event says, events without a line left out.

    A start that restores commits says so; a driver change warns; the commit count runs on from what
    the session restored.
    """
    rows = journal.where(~F.col("event").isin(*QUIET)) if minimal else journal
    counts = running_commits(journal).select("search_id", "seq", "done", F.col("tasks").alias("all"))
    told = rows.join(counts, ["search_id", "seq"], "left")
    have = set(told.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    line = F.when(
        F.col("event") == "search_started",
        F.when(F.col("restored") > 0, F.format_string("resuming: %d/%d committed, %d outstanding", F.col("restored"), F.col("tasks"), F.greatest(F.lit(0).cast("long"), F.col("tasks") - F.col("restored")))).otherwise(F.format_string("started: %d tasks", F.col("tasks"))),
    )
    for event, template in SAYS.items():
        line = line.when(F.col("event") == event, _filled(template, have, (*_SHORT, *(("from", "to") if event == "instance_replaced" else ()))))
    place = F.when(F.coalesce(col("host"), F.lit("")) == "", col("device")).otherwise(F.concat_ws(" on ", col("device"), col("host")))
    line = line.when(F.col("event") == "driver_changed", F.concat(F.lit("warning: the driver for "), place, F.lit(" changed: "), col("from"), F.lit(" is now "), col("to")))
    member = F.when(F.length(col("member")) > 0, F.concat(F.lit(" "), col("member"))).otherwise("")
    line = line.when(F.col("event") == "sending_search", F.concat(F.lit("sending the search"), member, F.lit(": "), col("objects").cast("string"), F.lit(" objects")))
    line = line.when(F.col("event") == "installing_program", F.concat(F.lit("installing the program"), member))
    gpus = col("gpu_count").cast("long")
    hardware = F.when((F.coalesce(gpus, F.lit(0)) == 0) | (F.coalesce(col("gpu_model"), F.lit("")) == ""), "no GPU").otherwise(F.concat(gpus.cast("string"), F.lit("× "), col("gpu_model")))
    rate = F.concat(dollars(col("rate_microusd_hour")), F.lit("/hr"))
    line = line.when(F.col("event") == "renting", F.concat(F.lit("renting"), member, F.lit(": "), hardware, F.lit(" on "), col("machine"), F.lit(" at "), rate))
    line = line.when(F.col("event") == "awaiting_machine", F.concat(F.lit("waiting for the machine"), member, F.lit(" to come up (pulls the image; up to "), F.floor(col("timeout_ms").cast("long") / 1000).cast("string"), F.lit("s)")))
    line = line.when(F.col("event") == "instance_online", F.concat(F.lit("instance online "), short(col("instance")), F.lit(" on "), col("host"), F.lit(": "), hardware, F.lit(" at "), rate))
    about = F.concat(col("level"), F.lit(" "), col("source"), F.when(col("worker").isNotNull(), F.concat(F.lit(" worker "), col("worker").cast("string"))).otherwise(""), F.lit(": "), col("message"))
    line = line.when((F.col("event") == "diagnostic") & col("level").isin("warn", "error"), about)
    return told.select("search_id", "seq", line.alias("line")).where("line is not null")


def status_block(status: DataFrame, composition: DataFrame) -> str:
    """The counters of one search, one a line, and its devices, busiest first."""
    r = status.first()
    names = ("tasks", "committed", "retried", "rejected", "faulted", "lease_expired", "checkpoint_degraded")
    lines = [("search", r["search_id"]), ("state", r["state"]), *[(n.replace("_", " "), r[n]) for n in names]]
    devices = composition.orderBy(F.desc("commits"), "label").collect()
    if devices:
        said = ", ".join(f"{d['label']} ×{d['commits']}" for d in devices)
        lines.append(("devices", said + (f", rebound chains: {r['rebound_chains']}" if r["rebound_chains"] else "")))
    width = max(len(k) for k, _ in lines)
    return "\n".join(f"{k:<{width}}  {v}" for k, v in lines)


def searches_block(summaries: DataFrame) -> str:
    # Fixed widths.
    rows = summaries.collect()
    if not rows:
        return "this store holds no search"
    lines = [f"{'search':<64}  {'state':<12}  committed"]
    return "\n".join(lines + [f"{r['search_id']:<64}  {r['state']:<12}  {r['committed']}/{r['tasks']}" for r in rows])


# Fixed layouts of the reports: headings, glyphs and widths.
DASH = "—"
ATTEMPTS = ("attempt", "worker", "host", "device", "outcome", "elapsed", "")
FAILURES = ("task", "final", "attempts", "worker", "reason")
WORKERS = ("worker", "device", "host", "spawn", "respawns", "util", "commits", "attempts")
LEVELS = " ▁▂▃▄▅▆▇█"
BARS = {"blank": " ", "light": "░", "full": "█"}


def grid(headings: Iterable[str], rows: Iterable[Iterable[str]], number_first: bool = False) -> str:
    """A text table: columns as wide as their widest cell, two blanks apart."""
    lines = [list(headings), *map(list, rows)]
    wide = [max(map(len, column)) for column in zip(*lines, strict=True)]
    return "\n".join("  " + "  ".join(c.rjust(w) if number_first and k == 0 else c.ljust(w) for k, (c, w) in enumerate(zip(line, wide, strict=True))).rstrip() for line in lines)


def state_text(state: str, task: str | None = None, reason: str | None = None) -> str:
    return f"failed on {(task or '')[:12]}: {reason}" if state == "failed" else state.replace("_", " ")


def span_text(ms: int) -> str:
    return f"{ms / 1000:.2f}s" if ms < 60_000 else f"{ms // 60_000}m{ms % 60_000 // 1000:02d}s"


def money(micro: int) -> str:
    return f"${int(micro) / 1_000_000:.3f}"


def _ratio(n: int, of: int, form: str, times: float = 1.0) -> str:
    return form.format(times * n / of) if of else DASH


def task_block(attempts: DataFrame, outcomes: DataFrame, latest: DataFrame, task: str) -> str:
    """One task's history: its state, a row for each attempt, and what it committed.

    attempts, outcomes: as ``journal.task_attempts`` and ``journal.task_outcomes`` give them, of one
    search. latest: (task, record, stats) with the rendered stats.
    """
    rows = attempts.where(F.col("task") == task).orderBy("number").collect()
    outcome = outcomes.where(F.col("task") == task).first()["outcome"]
    state = outcome.replace("_", " ")
    if outcome in ("rejected", "faulted") and rows:
        state = f"{outcome} on attempt {rows[-1]['attempt']}: {rows[-1]['reason'] or ''}"
    parts = [f"task     {task[:12]}\nstate    {state}"]
    if rows:
        cells = []
        for r in rows:
            note = " ".join(x for x in (r["reason"] if r["result"] in ("failed", "rejected", "faulted") else None, "(lease expired)" if r["lease_expired"] else None) if x)
            took = DASH if r["ended_ms"] is None else f"{max(0, r['ended_ms'] - r['started_ms']) / 1000:.1f}s"
            cells.append((str(r["attempt"]), f"w{r['worker']}", r["host"] or DASH, r["device"] or "(none)", r["result"].replace("_", " "), took, note))
        parts.append(grid(ATTEMPTS, cells, True))
    if outcome == "committed":
        done = latest.where(F.col("task") == task).first()
        parts.append(f"result   {done['record'][:12]}  {done['stats']}")
    return "\n\n".join(parts)


def failures_block(search: str, failed: DataFrame, attempts: DataFrame) -> str:
    """The tasks that a search did not commit, with the attempt that decided each."""
    last = attempts.groupBy("task").agg(F.count("*").alias("n"), F.max_by("worker", "number").alias("worker"), F.max_by("reason", "number").alias("reason"))
    rows = failed.select("task", "outcome").join(last, "task", "left").orderBy("task").collect()
    head = f"search {search[:12]}   {len(rows)} {'task' if len(rows) == 1 else 'tasks'} did not commit"
    if not rows:
        return head
    return head + "\n\n" + grid(FAILURES, [(r["task"][:12], r["outcome"], str(r["n"] or 0), DASH if r["worker"] is None else f"w{r['worker']}", r["reason"] or "") for r in rows])


def spend_block(closed: DataFrame, open_: DataFrame, total: int) -> str:
    """One owner's rentals: what closed ones cost, what open ones cost so far, and the total."""
    done, held = closed.orderBy("tag", "started_ms").collect(), open_.orderBy("tag").collect()
    lines = [f"closed rentals   {len(done)}"]
    lines += [f"  {r['tag']}  {span_text(max(0, r['ended_ms'] - r['started_ms']))}  {money(r['price_micro_usd_hour'])}/hr  {money(r['cost_micro_usd'])}" for r in done]
    lines.append(f"open rentals     {len(held)}")
    lines += [f"  {r['tag']}  {money(r['rate'])}/hr  {money(r['accrued'])} so far" for r in held]
    return "\n".join([*lines, f"total            {money(total)}"])


def machines_block(report: DataFrame) -> str:
    rows = report.orderBy("provider", "machine").collect()
    if not rows:
        return "no machine incidents recorded"
    lines = [f"machines with incidents   {len(rows)}   blacklisted   {sum(r['blacklisted'] for r in rows)}"]
    for r in rows:
        noun = "incident" if r["incidents"] == 1 else "incidents"
        kinds = f"(lost {r['lost']}, never-ready {r['never_ready']}, probe-failed {r['probe_failed']}, install-failed {r['install_failed']})"
        lines.append(f"  {r['provider']}-{r['machine']}  {r['incidents']} {noun} {kinds}" + "  blacklisted" * r["blacklisted"])
    return "\n".join(lines)


def timeline_block(log: DataFrame) -> str:
    """The latest session of one search: rates, workers, and a chart of 48 columns."""
    b, t = session_bounds(log).first(), session_retries(log).first()
    span = max(0, b["end_ms"] - b["start_ms"])
    speed = f"{b['session_committed'] * 1000 / span:.1f} task/s" if span else DASH
    head = f"search          {b['search_id']}\nwall-clock   {span_text(span)}\ncommitted    {b['committed']}\nthroughput   {speed}"
    rates = [
        ("retries / tasks", f"{t['retries']} / {b['tasks']}", _ratio(t["retries"], b["tasks"], "{:.2f} per task")),
        ("tasks retried / tasks", f"{t['retried_tasks']} / {b['tasks']}", _ratio(t["retried_tasks"], b["tasks"], "{:.1f}%", 100.0)),
        ("failed attempts / attempts", f"{t['failed_attempts']} / {t['total_attempts']}", _ratio(t["failed_attempts"], t["total_attempts"], "{:.1f}%", 100.0)),
    ]
    wide = [max(len(r[k]) for r in rates) for k in (0, 1)]
    told = "\n".join(f"  {a.ljust(wide[0])}  {c.rjust(wide[1])}  =  {x}" for a, c, x in rates)
    workers = worker_metrics(log).orderBy("worker").collect()
    cells = [(f"w{w['worker']}", w["device"] or "(none)", w["host"] or DASH, span_text(max(0, w["first_bind_ms"] - b["start_ms"])), str(w["respawns"]), _ratio(w["busy_ms"], w["lifespan_ms"], "{:.0f}%", 100.0), str(w["commits"]), str(w["attempts"])) for w in workers]
    parts = [head, f"retry rates\n{told}", grid(WORKERS, cells)]
    if span:
        lines = [("commits", "".join(LEVELS[r["level"]] for r in commit_sparkline(log).orderBy("column").collect()))]
        bars: dict[int, str] = {}
        for r in occupancy_buckets(log).orderBy("worker", "column").collect():
            bars[r["worker"]] = bars.get(r["worker"], "") + BARS[r["glyph"]]
        lines += [(f"w{k}", bar) for k, bar in sorted(bars.items())]
        first = max(len(k) for k, _ in lines)
        parts.append(f"each column spans {span_text(span // 48)}")
        parts.append("\n".join(f"  {k.ljust(first)}  {v}" for k, v in lines))
    return "\n\n".join(parts)


def summary_lines(latest: DataFrame) -> list[str]:
    """How many tasks committed, then how many have each rendered stats, most first. latest: (task, stats)."""
    groups = latest.groupBy("stats").count().orderBy(F.desc("count"), "stats").collect()
    return [f"{sum(g['count'] for g in groups)} committed tasks", *[f"{g['count']}  {g['stats']}" for g in groups]]


def report_lines(latest: DataFrame) -> list[str]:
    """One line a task, by task: its key and rendered stats."""
    return [f"{r['task']}  {r['stats']}" for r in latest.orderBy("task").collect()]


def write_lines(lines: Iterable[str], out=None) -> bool:
    """Writes lines; a reader that has gone away is no failure, and ends the writing with False."""
    out = out or sys.stdout
    try:
        for line in lines:
            out.write(f"{line}\n")
        out.flush()
    except BrokenPipeError:
        return False
    return True
