"""The heartbeat of a run on rented machines, and the ceiling on its time."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlode.operators import ledger

HEARTBEAT_S = 30


def heartbeat(instances: DataFrame, spend: DataFrame, polled: DataFrame, now_ms: int, max_spend: int | None, max_wall_clock_ms: int | None) -> DataFrame:
    """(owner, tag, action): what a beat does, for each owner's live rentals.

    An owner whose budget is used up winds down: that comes first and nothing is replaced. Otherwise a
    machine that its provider denies is replaced, and one that is ready or coming up is kept. polled:
    (instance, status) with ready, provisioning or gone; a machine that was not asked for is kept.
    """
    verdicts = ledger.budget_verdict(ledger.spend_report(instances, spend, now_ms), now_ms, max_spend, max_wall_clock_ms).select("owner", "verdict")
    closed = spend.select("owner", "tag", F.col("started_ms").alias("created_ms"))
    live = instances.where("state = 'live'").join(closed, ["owner", "tag", "created_ms"], "left_anti")
    asked = live.join(polled.select("instance", "status"), "instance", "left").join(verdicts, "owner", "left")
    action = F.when(F.coalesce("verdict", F.lit("within")) != "within", F.concat(F.lit("wind down: "), F.col("verdict"))).when(F.col("status") == "gone", "replace").otherwise("keep")
    return asked.select("owner", "tag", action.alias("action"))


def supervise(beats: DataFrame, act: Callable[[DataFrame], None], every_s: float = HEARTBEAT_S) -> StreamingQuery:
    """Runs ``act`` on each micro-batch of a stream, one beat at a time; a beat that fails is the next one's to mend."""

    def beat(batch: DataFrame, _: int) -> None:
        try:
            act(batch)
        except OSError as e:  # a provider that does not answer; its machines are asked again
            print(f"heartbeat: {e}")

    return beats.writeStream.foreachBatch(beat).trigger(processingTime=f"{every_s} seconds").start()


@dataclass
class Ceiling:
    """Whether the ceiling has come."""

    fired: bool = False


@contextmanager
def ceiling(limit_s: float | None, interrupt: Callable[[], None]) -> Iterator[Ceiling]:
    """Calls ``interrupt`` once if the body runs longer than the limit; no limit, no ceiling.

    The limit is one execution's: a search that is run again has all of it again.
    """
    state = Ceiling()
    if limit_s is None:
        yield state
        return

    def fire() -> None:
        state.fired = True
        interrupt()

    timer = threading.Timer(limit_s, fire)
    timer.daemon = True
    timer.start()
    try:
        yield state
    finally:
        timer.cancel()
        timer.join()
