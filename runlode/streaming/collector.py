"""The ingest side: a stream of events to log files, stamped as they arrive."""

from __future__ import annotations

import json
import time
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlode.sources.journal import append_lines

BATCH = 4096


def collect(events: DataFrame, folder: str, checkpoint: str, now_ms=lambda: int(time.time() * 1000), **trigger) -> StreamingQuery:
    """Appends a stream of (search_id, ord, event as JSON text) to one log a search.

    One writer stamps each event with its time of arrival and syncs at most 4096 of them at once, in
    the order of ord. The rows of a batch come to it piece by piece. A batch that is run again after a
    failure appends again; folds are safe against that only within one read, so readers that must not
    count twice start from the query's own checkpoint.
    """

    def write(batch: DataFrame, _: int) -> None:
        ordered = batch.orderBy("search_id", "ord")
        for search in [r["search_id"] for r in batch.select("search_id").distinct().orderBy("search_id").collect()]:
            rows = ordered.where(F.col("search_id") == search).toLocalIterator()
            while part := list(islice(rows, BATCH)):
                append_lines(f"{folder}/{search}.jsonl", [json.dumps({"ts_ms": now_ms()} | json.loads(r["event"])) for r in part])

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
