"""The status of searches, folded event by event: in batch for any log, and live over a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlode.operators.journal import SEARCH_LEVEL

COUNTED = {"committed": "committed", "retried": "retried", "rejected": "rejected", "faulted": "faulted", "lease_expired": "lease_expired", "checkpoint_degraded": "checkpoint_degraded", "chain_rebound": "rebound_chains"}
STATES = {"search_started": "in_progress", "search_finalized": "finalized", "search_failed": "failed", "search_interrupted": "interrupted"}
COLUMNS = ("seq", "event", "task", "worker", "device", "host", "tasks")
RESULT = "search_id string, seq long, tasks long, committed long, retried long, rejected long, faulted long, lease_expired long, checkpoint_degraded long, rebound_chains long, state string, devices string, occupancy string"


class Fold:
    """One search's status; ``apply`` takes its events in append order, whatever their stamps."""

    def __init__(self, saved: str | None = None):
        self.d = json.loads(saved) if saved else {"seq": -1, "tasks": 0, "state": "in_progress", "devices": {}, "held": {}, "bound": {}} | dict.fromkeys(COUNTED.values(), 0)

    def saved(self) -> str:
        return json.dumps(self.d, sort_keys=True)

    def apply(self, seq: int, event: str, task: str | None, worker: int | None, device: str | None, host: str | None, tasks: int | None) -> None:
        d = self.d
        if seq <= d["seq"]:  # a batch that is read again changes nothing
            return
        d["seq"] = seq
        if event in COUNTED:
            d[COUNTED[event]] += 1
        if event in SEARCH_LEVEL:
            d["state"], d["held"] = STATES[event], {}
            if event == "search_started":
                d["tasks"] = tasks or 0
        elif event == "leased":
            d["held"][str(worker)] = task
        elif event == "worker_bound":
            d["bound"][str(worker)] = [device or "", host or ""]
        elif event in ("committed", "failed", "rejected", "faulted"):
            holders = sorted(int(w) for w, t in d["held"].items() if t == task)
            if holders:
                del d["held"][str(holders[0])]
                device, host = d["bound"].get(str(holders[0]), ("", ""))
                if event == "committed" and device:
                    label = f"{device} @ {host}" if host else device
                    d["devices"][label] = d["devices"].get(label, 0) + 1

    def row(self, search_id: str) -> pd.DataFrame:
        d = self.d
        return pd.DataFrame([{"search_id": search_id, "seq": d["seq"], "tasks": d["tasks"], **{c: d[c] for c in COUNTED.values()}, "state": d["state"], "devices": json.dumps(d["devices"], sort_keys=True), "occupancy": json.dumps(d["held"], sort_keys=True)}])

    def take(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("seq").astype(object).where(rows.sort_values("seq").notna(), None)
        for r in rows[list(COLUMNS)].itertuples(index=False):
            self.apply(int(r.seq), r.event, r.task, None if r.worker is None else int(r.worker), r.device, r.host, None if r.tasks is None else int(r.tasks))


def fold_statuses(journal: DataFrame) -> DataFrame:
    """The exact status of each search, one task a search, for logs in which workers share tasks.

    Events that change nothing stay where they are; the rest of a search's log meets in one task, as
    the fold is sequential. ``runlode.operators.journal`` answers without that where tasks have one
    holder.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fold = Fold()
        fold.take(rows)
        return fold.row(key[0])

    return _acting(journal).groupBy("search_id").applyInPandas(run, RESULT)


def _acting(journal: DataFrame) -> DataFrame:
    acts = (*COUNTED, *SEARCH_LEVEL, "leased", "failed", "worker_bound")
    return journal.where(F.col("event").isin(*acts)).select("search_id", *COLUMNS)


def follow_statuses(stream: DataFrame) -> DataFrame:
    """The same fold over a stream: each batch gives the new status of the searches it touched."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(state.get[0] if state.exists else None)
        fold.take(pd.concat(list(batches)))
        state.update((fold.saved(),))
        yield fold.row(key[0])

    return _acting(stream).groupBy("search_id").applyInPandasWithState(run, RESULT, "saved string", "update", GroupStateTimeout.NoTimeout)


def lease_timeouts(stream: DataFrame, limit_ms: int) -> DataFrame:
    """(search_id, task, event): lease_expired, then failed, for leases held longer than the limit.

    stream: events with search_id, seq, event and task. A lease's timer runs in processing time from
    the batch that brought it and ends with the task's outcome.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"search_id": [key[0]] * 2, "task": [key[1]] * 2, "event": ["lease_expired", "failed"]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        last = rows["event"].iloc[-1]
        if last == "leased":
            state.update((True,))
            state.setTimeoutDuration(limit_ms)
        elif state.exists:
            state.remove()

    acts = stream.where(F.col("event").isin("leased", "committed", "failed", "rejected", "faulted")).select("search_id", "seq", "event", "task")
    return acts.groupBy("search_id", "task").applyInPandasWithState(run, "search_id string, task string, event string", "held boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _in_order(rows: DataFrame, keys: list[str], columns: list[str], step: Callable, begin: object) -> DataFrame:
    """The rows that ``step`` lets through, each key's rows in the order of the first column.

    step(state, row) gives (state, whether the row goes through). Rows of a key meet in one task, sorted,
    and pass one by one; what a task holds is one state and one batch.
    """
    ready = rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in columns]).repartition(*keys).sortWithinPartitions(*keys, *columns)
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, begin
        for batch in batches:
            kept = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:n] != now:
                    now, state = r[:n], begin
                state, through = step(state, r[n:])
                kept.append(through)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ready.mapInArrow(fold, ready.schema)


def limited(rows: DataFrame, keys: list[str], gap_ms: int = 10_000) -> DataFrame:
    """Rows (keys, seq, ts_ms) that may be told: the first of a key, then none within the gap of the last told.

    Which row is told depends on the one told before, so a key's rows are folded in order; the fold
    carries one number.
    """

    def step(last: int | None, row: tuple) -> tuple[int | None, bool]:
        due = last is None or row[1] - last >= gap_ms
        return (row[1] if due else last), due

    return _in_order(rows, keys, ["seq", "ts_ms"], step, None)


def saves(rows: DataFrame, keys: list[str], every: int | None, interval_ms: int | None) -> DataFrame:
    """Offers (keys, seq, ts_ms, start_ms) at which a checkpoint is saved.

    One is due at every ``every``-th offer since the last save or when the interval since it has
    passed; the clock starts at start_ms. A save resets both.
    """

    def step(state: tuple[int, int | None], row: tuple) -> tuple[tuple[int, int | None], bool]:
        n, last = state[0] + 1, state[1]
        since = row[1] - (row[2] if last is None else last)
        due = every is not None and n >= every or interval_ms is not None and since >= interval_ms
        return ((0, row[1]) if due else (n, last)), due

    return _in_order(rows, keys, ["seq", "ts_ms", "start_ms"], step, (0, None)).select(*keys, "seq", "ts_ms")
