"""The event log as files of JSON lines: read in batch, followed as a stream, appended to.

A file holds one search's log and is named for it (``<search_id>.jsonl``). Its order is the order of
its lines. Bytes after the last line feed are a torn tail, an append that was cut off, and are not
read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

LINES = "search_id string, seq long, offset long, line string"

#: The kinds of events, fixed.
KINDS = (
    "search_started", "queued", "leased", "committed", "failed", "retried", "rejected", "faulted", "lease_expired", "checkpoint_degraded",
    "checkpointed", "worker_bound", "program_bound", "driver_changed", "chain_rebound", "search_finalized", "search_failed", "search_interrupted", "renting", "awaiting_machine",
    "sending_search", "installing_program", "starting_search", "acquisition_abandoned", "instance_online", "instance_lost", "instance_replaced", "budget_spend_exhausted", "budget_wall_clock_exhausted", "diagnostic",
)
_TEXT = ("event", "task", "record", "device", "host", "driver", "program", "reason", "error", "stats_blob_hex", "format", "binary", "digest", "chain", "from", "to", "search", "level", "source", "message", "tag", "instance", "gpu_model", "member", "machine")
_LONG = ("ts_ms", "tasks", "committed", "worker", "attempt", "next_attempt", "elapsed_ms", "gpu_count", "rate_microusd_hour", "timeout_ms", "objects", "released", "accrued_microusd", "cap_microusd", "deadline_ms")
#: All fields of all events beside each other; an absent one is null.
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.LongType()) for n in _LONG]
    + [T.StructField("stats", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]))), T.StructField("corrupt", T.StringType())]
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(search_id, seq, offset, line) of all files at ``path``, by Spark's own readers.

    Files are read in splits. Lines are numbered and their bytes added up within a split, in the order
    in which they were read, and over the splits of a file before it; no task has more than a split. A
    line that is no UTF-8 is an error, and so is a missing path, which ``read_journal`` turns into no
    rows.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), (F.octet_length("value") + 1).cast("long").alias("n"))
    order = Window.partitionBy("file", "split").orderBy("at")
    placed = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("o", F.sum("n").over(order) - F.col("n"))
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("lines"), F.sum("n").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = splits.select("file", "split", F.coalesce(F.sum("lines").over(before), zero).alias("first"), F.coalesce(F.sum("bytes").over(before), zero).alias("begin"))
    joined = placed.join(starts, ["file", "split"]).withColumn("offset", F.col("begin") + F.col("o"))
    # A line that no line feed ends is none, and nothing may look into it, however the plan is ordered.
    whole = joined.withColumn("line", F.when(F.col("offset") + F.col("n") <= F.col("size"), F.col("line"))).where("line is not null")
    valid = F.assert_true(F.coalesce(F.is_valid_utf8("line"), F.lit(True)), F.lit("a line of the journal is no UTF-8"))
    return whole.where(valid.isNull()).select(F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("search_id"), (F.col("first") + F.col("k")).cast("long").alias("seq"), "offset", "line")


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Events from lines. Strict: a line that is no event is an error; else it is left out. A null line is none.

    A statistic that is null in the log is not a number.
    """
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    schema = T.StructType(EVENT.fields[:-1]) if strict else EVENT
    read = lines.withColumn("e", F.from_json("line", schema, mode))
    known = F.coalesce(F.col("e.event").isin(*KINDS) & F.col("e.ts_ms").isNotNull(), F.lit(False))
    if strict:
        read = read.where("line is not null").where(F.assert_true(F.col("line").isNull() | known, F.lit("a line of the journal is no event")).isNull())
    else:
        read = read.where(F.col("e.corrupt").isNull() & known)
    stats = F.transform("e.stats", lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["value"], F.lit(float("nan"))).alias("value")))
    fields = [F.col(f"e.{n}").alias("restored" if n == "committed" else n) for n in (*_TEXT, *_LONG)]
    return read.select("search_id", "seq", *fields, stats.alias("stats"))


def read_journal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All events at ``path``; none if there is no such path."""
    try:
        lines = read_lines(spark, path)
    except Exception as e:  # only the missing path is not an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], LINES)
    return parse(lines, strict)


def to_lines(events: DataFrame) -> DataFrame:
    """(search_id, seq, line): events as JSON text, as ``parse`` reads it; numbers that are none become null."""
    have = set(events.columns)
    stats = F.transform("stats", lambda s: F.struct(s["name"].alias("name"), F.when(~F.isnan(s["value"]) & (F.abs(s["value"]) < float("inf")), s["value"]).alias("value")))
    fields = [F.col(f"`{'restored' if n == 'committed' else n}`").alias(n) for n in (*_LONG[:1], *_TEXT, *_LONG[1:]) if ("restored" if n == "committed" else n) in have]
    if "stats" in have:
        fields.append(stats.alias("stats"))
    return events.select("search_id", "seq", F.to_json(F.struct(*fields)).alias("line"))


def append_lines(path: str, lines: Sequence[str]) -> None:
    """Appends a batch by one write and one sync. Empty lines and line breaks in a line are refused."""
    for line in lines:
        if not line or "\n" in line or "\r" in line:
            raise ValueError("a line is empty or holds a line break")
    with open(path, "ab") as f:
        f.write("".join(f"{x}\n" for x in lines).encode())
        f.flush()
        os.fsync(f.fileno())


def complete_region(path: str, offset: int) -> tuple[bytes, int]:
    """The bytes of whole lines from ``offset``, and where they end; none of a missing file."""
    try:
        with open(path, "rb") as f:
            f.seek(offset)
            data = f.read()
    except FileNotFoundError:
        return b"", offset
    end = data.rfind(b"\n") + 1
    return data[:end], offset + end


def _search_of(path: str) -> str:
    return os.path.basename(path).removesuffix(".jsonl")


def _rows(path: str, data: bytes, offset: int, seq: int) -> Iterator[tuple]:
    for k, raw in enumerate(data.split(b"\n")[:-1]):
        yield (_search_of(path), seq + k, offset, raw.decode())
        offset += len(raw) + 1


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data, _ = complete_region(partition.value, 0)
        yield from _rows(partition.value, data, 0, 0)


class _Follower(SimpleDataSourceStreamReader):
    """Offsets are bytes and lines; nothing is consumed without a whole line."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"bytes": 0, "lines": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        data, end = complete_region(self.path, start["bytes"])
        rows = list(_rows(self.path, data, start["bytes"], start["lines"]))
        return iter(rows), {"bytes": end, "lines": start["lines"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(start["bytes"])
            data = f.read(end["bytes"] - start["bytes"])
        return _rows(self.path, data, start["bytes"], start["lines"])


class JournalSource(DataSource):
    """``format("runlode_journal")`` with option path: one log file, in batch or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "runlode_journal"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Follower(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the log's events, from its start."""
    spark.dataSource.register(JournalSource)
    return parse(spark.readStream.format("runlode_journal").option("path", path).load())
