"""Queries over the content-addressed store: closures, collection, synchronisation and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlode.lineage import checkpointed

PACK_CAP = 1 << 30
INVENTORY_FRAME = 4096


def closure(manifests: DataFrame, references: DataFrame) -> DataFrame:
    """(search_id, object): records and all they refer to, once for each search."""
    records = manifests.select("search_id", F.col("record_hash").alias("object"))
    referred = manifests.select("search_id", "record_hash").join(references, "record_hash").select("search_id", "object")
    return records.unionByName(referred).distinct()


def live_objects(searches: DataFrame, manifests: DataFrame, references: DataFrame) -> DataFrame:
    """What the finalized searches hold."""
    kept = manifests.join(searches.where("finalized").select("search_id"), "search_id", "left_semi")
    return kept.select(F.col("record_hash").alias("object")).unionByName(references.join(kept, "record_hash", "left_semi").select("object")).distinct()


def gc_doomed(held: DataFrame, live: DataFrame) -> DataFrame:
    """Held objects that nothing live refers to; unfinalized work goes too."""
    return held.join(live, "object", "left_anti")


def doomed_index(manifests: DataFrame, doomed: DataFrame) -> DataFrame:
    """Index rows whose record goes; they are deleted before the objects."""
    return manifests.join(doomed.select(F.col("object").alias("record_hash")), "record_hash", "left_semi")


def removal_plan(search_id, searches: DataFrame, manifests: DataFrame, references: DataFrame) -> DataFrame:
    """Objects that go when one search goes: its closure less all survivors' closures.

    Raises if another search is not finalized, since what that one needs is not known yet.
    """
    if not searches.where((F.col("search_id") != search_id) & ~F.col("finalized")).isEmpty():
        raise ValueError("another search is not finalized")
    return removal_objects(search_id, manifests, references)


def removal_objects(search_id, manifests: DataFrame, references: DataFrame) -> DataFrame:
    own = closure(manifests.where(F.col("search_id") == search_id), references).select("object")
    others = manifests.where(F.col("search_id") != search_id)
    rest = others.select(F.col("record_hash").alias("object")).unionByName(references.join(others, "record_hash", "left_semi").select("object"))
    return own.join(rest, "object", "left_anti")


def sync_want(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    return theirs.select("task_key", "record").join(mine.select("task_key"), "task_key", "left_anti")


def sync_divergence(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    """Keys that both sides have with different records; any is an error."""
    return theirs.select("task_key", F.col("record").alias("their_record")).join(mine.select("task_key", F.col("record").alias("my_record")), "task_key").where("their_record <> my_record")


def synchronized(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    """The union of two stores, or ValueError if they diverge."""
    if not sync_divergence(theirs, mine).isEmpty():
        raise ValueError("stores diverge")
    return mine.select("task_key", "record").unionByName(sync_want(theirs, mine))


def push_objects(components: DataFrame, produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Identity components, and the produced states that no later task of the push consumes."""
    return produced.join(consumed, "object", "left_anti").unionByName(components).select("object").distinct()


def frontier(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate tasks that have no record."""
    return candidates.join(index.select("task_key"), "task_key", "left_anti")


def missing_references(references: DataFrame, held: DataFrame) -> DataFrame:
    """References to objects that are not held; a commit with any is refused."""
    return references.join(held.select("object"), "object", "left_anti")


def put(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (hash, bytes) of ``new`` that the store lacks, once each."""
    return new.dropDuplicates(["hash"]).join(objects.select("hash"), "hash", "left_anti")


def put_if_absent(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New rows for keys that are absent; raises if a present key has another value."""
    clash = table.select(key, F.col(value).alias("_old")).join(new, key).where(~F.col("_old").eqNullSafe(F.col(value)))
    if not clash.isEmpty():
        raise ValueError("a key is present with another value")
    return new.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def loose_estimate(objects: DataFrame) -> DataFrame:
    """Number of loose objects, from those in the first of 256 folders."""
    return objects.agg((F.count(F.when(F.col("hash").startswith("00"), 1)) * 256).alias("estimate"))


def loose_split(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Loose objects with whether a pack already has them."""
    p = packed.select("hash", F.lit(True).alias("duplicate")).dropDuplicates(["hash"])
    return loose.join(p, "hash", "left").fillna(False, ["duplicate"])


def pack_groups(objects: DataFrame, cap: int = PACK_CAP, digits: int = 1) -> DataFrame:
    """(shard, pack, objects, bytes): greedy groups in hash order under a cap.

    Packs are cut within a shard, the first ``digits`` hex digits, of which a store of any size takes
    as many as it needs; an object larger than the cap stands alone. The sum restarts with each pack,
    so a shard's sizes are folded in order, and the fold carries three numbers.
    """
    shards = 16**digits
    shard = F.conv(F.substring("hash", 1, digits), 16, 10).cast("int")
    dealt = objects.select(shard.alias("shard"), "hash", F.col("size").cast("long").alias("size")).repartition(shards, "shard").sortWithinPartitions("shard", "hash").select("shard", "size")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int, int]] = []
        now, pack, n, total = None, 0, 0, 0
        for batch in batches:
            for own, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != now or total + size > cap:
                    if n:
                        done.append((now, pack, n, total))
                    pack = pack + 1 if own == now else 0
                    now, n, total = own, 0, 0
                n, total = n + 1, total + size
        if n:
            done.append((now, pack, n, total))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "pack", "objects", "bytes"), r, strict=True)) for r in done], schema=pa.schema([("shard", pa.int32()), ("pack", pa.int32()), ("objects", pa.int64()), ("bytes", pa.int64())]))

    return dealt.mapInArrow(fold, "shard int, pack int, objects long, bytes long")


def manifest_json(manifests: DataFrame) -> DataFrame:
    """(search_id, json): each search's manifest in canonical form, ascending by task."""
    return manifests.groupBy("search_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("task_key").alias("task"), F.col("record_hash").alias("record"))))).alias("json"))


def finalize(search_tasks: DataFrame, index: DataFrame) -> DataFrame:
    """The manifest of a search: every task with its record; raises on repeats or missing records."""
    if not search_tasks.groupBy("task_key").count().where("count > 1").isEmpty():
        raise ValueError("a task is listed twice")
    joined = search_tasks.join(index.select("task_key", "record_hash"), "task_key", "left")
    if not joined.where("record_hash is null").isEmpty():
        raise ValueError("a task has no record")
    return joined.orderBy("task_key")


def ascending_faults(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Rows whose name does not come strictly after the one before."""
    before = F.lag(name).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(name))


def frames(inventory: DataFrame, group: str, key: str, size: int = INVENTORY_FRAME, ranges: int = 64) -> DataFrame:
    """(group, frame, entries, first, last): an ordered inventory in frames of a bounded number.

    Rows are numbered within ranges of (group, key), from the counts of the ranges before.
    """
    ranged = inventory.select(group, key).repartitionByRange(ranges, group, key)
    rows = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key)) - 1
    numbered = rows.withColumn("_own", own).join(starts, [group, "_range"])
    return numbered.withColumn("frame", F.floor((F.col("_start") + F.col("_own")) / size)).groupBy(group, "frame").agg(F.count("*").alias("entries"), F.min(key).alias("first"), F.max(key).alias("last"))


def insertion_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def chain_walk(spark, starts: DataFrame, links: DataFrame, segments: int) -> DataFrame:
    """(chain, segment, state): follows each chain's state from link to link, ``segments`` times at most.

    One join a segment, all chains at once; a fixed point repeats its state and still counts its hops.
    """
    now = starts.select("chain", F.lit(0).alias("segment"), "state")
    walked = now
    for k in range(1, segments):
        now = checkpointed(now.join(links.select("state", "next_state"), "state").select("chain", F.lit(k).alias("segment"), F.col("next_state").alias("state")))
        walked = walked.unionByName(now)
    return walked
