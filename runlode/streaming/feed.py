"""Following a search from afar: frames on a byte stream, and when a follower may stop.

A stream opens with Hello; the first Records frame is always sent, empty or not, and completes the
history; then come Records as lines are appended, and Holder when the search's lock changes hands. A
snapshot ends with Complete, a failure with Fault.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlode.functions.codec import Decoder, Encoder
from runlode.operators.journal import SEARCH_LEVEL

PROTOCOL = 2
#: Which byte starts which frame, fixed.
HELLO, RECORDS, HOLDER, COMPLETE, FAULT = range(5)
MOST_BYTES = 64 << 20  #: of one frame


@dataclass(frozen=True)
class Frame:
    kind: int
    protocol: int = PROTOCOL
    search: bytes = bytes(32)
    format: str = ""
    workers: int = 0
    holder: str | None = None
    lines: tuple[str, ...] = ()
    error: str = ""


def _maybe_text(enc: Encoder, value: str | None) -> None:
    enc.flag(value is not None)
    if value is not None:
        enc.text(value)


def encode(f: Frame) -> bytes:
    enc = Encoder().u8(f.kind)
    if f.kind == HELLO:
        enc.u32(f.protocol).digest(f.search).text(f.format).u32(f.workers)
        _maybe_text(enc, f.holder)
    elif f.kind == RECORDS:
        enc.u32(len(f.lines))
        for line in f.lines:
            enc.text(line)
    elif f.kind == HOLDER:
        _maybe_text(enc, f.holder)
    elif f.kind == FAULT:
        enc.text(f.error)
    return enc.done()


def decode(data: bytes) -> Frame:
    """The frame; ValueError if the bytes are none or speak another protocol."""
    dec = Decoder(data)
    kind = dec.u8()
    if kind == HELLO:
        protocol = dec.u32()
        if protocol != PROTOCOL:
            raise ValueError(f"the far side speaks protocol {protocol}, this one {PROTOCOL}")
        f = Frame(kind, protocol, dec.digest(), dec.text(), dec.u32(), dec.text() if dec.flag() else None)
    elif kind == RECORDS:
        f = Frame(kind, lines=tuple(dec.text() for _ in range(dec.u32())))
    elif kind == HOLDER:
        f = Frame(kind, holder=dec.text() if dec.flag() else None)
    elif kind == COMPLETE:
        f = Frame(kind)
    elif kind == FAULT:
        f = Frame(kind, error=dec.text())
    else:
        raise ValueError(f"no frame begins with {kind}")
    dec.end()
    return f


def write(out: BinaryIO, f: Frame) -> None:
    data = encode(f)
    out.write(struct.pack("<I", len(data)) + data)


def read(source: BinaryIO) -> Iterator[Frame]:
    """Frames up to the end of the stream; one that is cut off is an error."""
    while head := source.read(4):
        if len(head) < 4 or (n := struct.unpack("<I", head)[0]) > MOST_BYTES:
            raise ValueError("a frame is cut off or too large")
        if len(data := source.read(n)) < n:
            raise ValueError("a frame is cut off")
        yield decode(data)


def serve(out: BinaryIO, hello: Frame, polls: Iterable[tuple[list[str], str | None]]) -> None:
    """Writes a stream from polls of (new lines, holder); an error becomes the Fault frame.

    The first poll's lines are the history. With one poll the stream is a snapshot.
    """
    try:
        holder, n = hello.holder, 0
        write(out, hello)
        for n, (lines, now) in enumerate(polls, 1):
            if lines or n == 1:
                write(out, Frame(RECORDS, lines=tuple(lines)))
            if now != holder:
                holder = now
                write(out, Frame(HOLDER, holder=now))
        write(out, Frame(COMPLETE))
    except (OSError, ValueError) as e:
        write(out, Frame(FAULT, error=str(e)))


@dataclass
class Follower:
    """What a reader knows after each frame; ``take`` gives the lines that it brings."""

    hello: Frame | None = None
    complete_history: bool = False
    over: bool = False
    holder: str | None = None
    seen: int = field(default=0)

    def take(self, f: Frame) -> tuple[str, ...]:
        if self.hello is None and f.kind not in (HELLO, FAULT):
            raise ValueError("a stream opens with Hello")
        if f.kind == HELLO:
            self.hello, self.holder = f, f.holder
        elif f.kind == RECORDS:
            self.complete_history = True
            self.seen += len(f.lines)
            return f.lines
        elif f.kind == HOLDER:
            self.holder = f.holder
        elif f.kind == COMPLETE:
            self.over = True
        else:
            raise ValueError(f.error)
        return ()


#: The exit codes of a follower by the state in which a search ends, fixed.
EXITS = {"finalized": 0, "in_progress": 0, "failed": 1, "interrupted": 2}


def ended(state: str, drained: bool, holder: str | None) -> bool:
    """Whether a follower is done: the search has ended, or all is read and nobody drives it."""
    return state != "in_progress" or drained and holder is None


def terminations(journal: DataFrame, holders: DataFrame) -> DataFrame:
    """(search_id, state, over, exit): where followers of the searches stand once the log is drained.

    holders: (search_id, holder) of searches whose lock is held.
    """
    last = journal.where(F.col("event").isin(*SEARCH_LEVEL)).groupBy("search_id").agg(F.max_by("event", "seq").alias("last"))
    known = journal.select("search_id").distinct().join(last, "search_id", "left").join(holders.select("search_id", "holder"), "search_id", "left")
    state = F.when(F.col("last") == "search_finalized", "finalized").when(F.col("last") == "search_failed", "failed").when(F.col("last") == "search_interrupted", "interrupted").otherwise("in_progress")
    over = (F.col("state") != "in_progress") | F.col("holder").isNull()
    code = F.create_map(*[F.lit(x) for kv in EXITS.items() for x in kv])
    return known.withColumn("state", state).select("search_id", "state", over.alias("over"), F.when(over, code[F.col("state")]).alias("exit"))


def follow_until_ended(query: StreamingQuery, state: Callable[[], str], holder: Callable[[], str | None], poll_s: float = 0.2) -> str:
    """Stops a streaming query once its search has ended or is drained with nobody driving it; its state."""
    while True:
        over = query.awaitTermination(poll_s)
        now = state()
        idle = not query.isActive or not query.status["isDataAvailable"] and not query.status["isTriggerActive"]
        if over or ended(now, idle, holder()):
            query.stop()
            return now
