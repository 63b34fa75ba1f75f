"""The store as it lies on disk: loose objects, packs, slots and payloads, and what maintenance reports.

Loose objects are rows (hash, bytes); packed ones (pack, position, hash, bytes). Slots are small keyed
records that a newer write replaces and whose damage is no error.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.functions.codec import NAMESPACE, Decoder, Encoder
from runlode.operators import store

#: Tags that slot files begin with.
CHECKPOINT_TAG, PLACEMENT_TAG = f"{NAMESPACE}.checkpoint.v1", f"{NAMESPACE}.placement.v1"


def held_objects(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Every object that the store has, in either form, once."""
    return loose.select("hash").unionByName(packed.select("hash")).distinct()


def present(keys: DataFrame, loose: DataFrame, packed: DataFrame) -> DataFrame:
    """(hash, present) for each asked hash."""
    held = held_objects(loose, packed).withColumn("present", F.lit(True))
    return keys.select("hash").join(held, "hash", "left").fillna(False, ["present"])


def get(keys: DataFrame, loose: DataFrame, packed: DataFrame, hash_of: Column | None = None) -> DataFrame:
    """(hash, bytes) of the asked objects, the loose form before a packed one.

    An object that is nowhere and bytes that do not have their hash are errors.
    """
    made = hash_of if hash_of is not None else F.sha2("bytes", 256)
    forms = loose.select("hash", F.lit(0).alias("form"), "bytes").unionByName(packed.select("hash", F.lit(1).alias("form"), "bytes"))
    asked = keys.select("hash").distinct()
    found = forms.join(asked, "hash", "left_semi").groupBy("hash").agg(F.min_by("bytes", "form").alias("bytes"))
    out = asked.join(found, "hash", "left")
    there = F.assert_true(F.col("bytes").isNotNull(), F.concat(F.lit("no object "), F.col("hash")))
    whole = F.assert_true(made == F.col("hash"), F.lit("an object does not have its hash"))
    return out.where(there.isNull()).where(whole.isNull())


def task_index(index: DataFrame) -> DataFrame:
    """(task_key, record_hash) in the order of the keys."""
    return index.select("task_key", "record_hash").orderBy("task_key")


def pack_faults(packed: DataFrame) -> DataFrame:
    """(pack, position, fault) of index entries that break the rules of a pack.

    Hashes ascend strictly, offsets begin where the entry before ended, and lengths are not negative.
    packed: (pack, position, hash, start, length).
    """
    before = Window.partitionBy("pack").orderBy("position")
    rows = packed.withColumn("_hash", F.lag("hash").over(before)).withColumn("_end", F.lag(F.col("start") + F.col("length")).over(before))
    fault = F.when(F.col("length") < 0, "negative length").when(F.col("_hash") >= F.col("hash"), "not ascending").when(F.col("start") != F.coalesce("_end", F.lit(0)), "gap or overlap")
    return rows.select("pack", "position", fault.alias("fault")).where("fault is not null")


def compaction(loose: DataFrame, packed: DataFrame, cap: int = store.PACK_CAP) -> tuple[DataFrame, DataFrame]:
    """(packs, report) of packing all that is loose: groups under the cap, and one row of counters.

    loose: (hash, size, stored) with the bytes as they are and as they will be stored. Loose objects
    that a pack has already are removed and not packed again.
    """
    split = store.loose_split(loose, packed)
    fresh = split.where(~F.col("duplicate"))
    packs = store.pack_groups(fresh.select("hash", "size"), cap)
    written = packs.agg(F.count("*").alias("packs_written"))
    counted = split.agg(
        F.count(F.when(~F.col("duplicate"), 1)).alias("objects_packed"),
        F.count("*").alias("loose_removed"),
        F.coalesce(F.sum(F.when(~F.col("duplicate"), F.col("size"))), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.when(~F.col("duplicate"), F.col("stored"))), F.lit(0)).alias("stored_bytes"),
    )
    return packs, counted.join(written).select("objects_packed", "packs_written", "loose_removed", "raw_bytes", "stored_bytes")


def stored_size(data: Column, compressed: Column) -> Column:
    """Bytes of an object in a pack: compressed only if that is smaller."""
    return F.least(F.octet_length(data), F.octet_length(compressed)).cast("long")


def removal_report(doomed: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: objects and index entries that go with a removal."""
    index = store.doomed_index(manifests.select("task_key", "record_hash").distinct(), doomed)
    return doomed.agg(F.count("*").alias("objects_removed")).join(index.agg(F.countDistinct("task_key").alias("index_entries_removed")))


def gc_report(held: DataFrame, searches: DataFrame, manifests: DataFrame, references: DataFrame, packed: DataFrame) -> DataFrame:
    """One row: what a collection deletes, and how many packs and searches it touches."""
    doomed = store.gc_doomed(held, store.live_objects(searches, manifests, references))
    removed = removal_report(doomed, manifests)
    rewritten = packed.select("pack", F.col("hash").alias("object")).join(doomed, "object", "left_semi").agg(F.countDistinct("pack").alias("packs_rewritten"))
    gone = searches.where(~F.col("finalized")).agg(F.count("*").alias("searches_removed"))
    return removed.join(rewritten).join(gone)


def sync_report(ours: DataFrame, theirs: DataFrame, our_objects: DataFrame, their_objects: DataFrame) -> DataFrame:
    """One row: records (task_key) and objects (object) that each side sends to the other."""

    def lacking(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
        return a.select(key).distinct().join(b.select(key), key, "left_anti").agg(F.count("*").alias(name))

    return (
        lacking(ours, theirs, "task_key", "records_sent")
        .join(lacking(theirs, ours, "task_key", "records_received"))
        .join(lacking(our_objects, their_objects, "object", "objects_sent"))
        .join(lacking(their_objects, our_objects, "object", "objects_received"))
    )


def offered(keys: DataFrame, index: DataFrame, named: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a side advertises: the records it holds of the asked keys, and the named objects it holds."""
    records = index.select("task_key", "record_hash").join(keys.select("task_key"), "task_key", "left_semi")
    return records, named.select("object").distinct().join(held.select("object"), "object", "left_semi")


def replica_faults(records: DataFrame, held: DataFrame, whole: bool = False) -> DataFrame:
    """(task_key, part, object) that a record needs and the store lacks.

    records: (task_key, spec, params, environment, input_state, artifacts). A partial replica needs the
    spec, the parameters and the environment only; a whole one all it names.
    """
    parts = [F.struct(F.lit(p).alias("part"), F.col(p).alias("object")) for p in ("spec", "params", "environment", *(["input_state"] if whole else []))]
    needed = F.array(*parts)
    if whole:
        needed = F.concat(needed, F.transform("artifacts", lambda a: F.struct(F.lit("artifact").alias("part"), a.alias("object"))))
    asked = records.select("task_key", F.explode(needed).alias("x")).select("task_key", "x.part", "x.object").where("object is not null")
    return asked.join(held.select("object"), "object", "left_anti").select("task_key", "part", "object")


def commit_partial(records: DataFrame, held: DataFrame) -> DataFrame:
    """The records, or ValueError if one names a spec, parameters or environment that is not held."""
    if not replica_faults(records, held).isEmpty():
        raise ValueError("a record names an object that is not held")
    return records


def save_slots(slots: DataFrame, writes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table of slots after writes (keys, owner, payload): the last write of a key stays."""
    rows = slots.withColumn("_gen", F.lit(0)).withColumn("_at", F.lit(None).cast("long")).unionByName(writes.withColumn("_gen", F.lit(1)).withColumn("_at", F.col(order).cast("long")).drop(order))
    value = [c for c in slots.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct("_gen", "_at")).alias("_v")).select(*keys, "_v.*")


def load_checkpoints(slots: DataFrame, tasks: DataFrame) -> DataFrame:
    """(search_id, slot, task_key, payload): what each task may resume from, null if nothing.

    slots: (search_id, slot, owner, payload) with null owner or payload where the frame was torn. A
    slot that another task wrote reads as nothing.
    """
    found = slots.where("owner is not null and payload is not null").select("search_id", "slot", F.col("owner").alias("task_key"), "payload")
    return tasks.select("search_id", "slot", "task_key").join(found, ["search_id", "slot", "task_key"], "left")


def chain_bindings(slots: DataFrame) -> DataFrame:
    """(search_id, chain, payload) of all placement slots that are whole."""
    return slots.where("chain is not null and payload is not null").select("search_id", "chain", "payload")


def payload_closure(files: DataFrame) -> DataFrame:
    """(digest, object): each payload and the files that it names."""
    return files.select("digest", F.col("digest").alias("object")).unionByName(files.select("digest", "object")).distinct()


def payload_faults(files: DataFrame, installs: DataFrame) -> DataFrame:
    """(digest, fault) of payloads that cannot be: a path twice, or many files and no install script.

    files: (digest, path, executable, object). installs: (digest, install).
    """
    counted = files.groupBy("digest").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.max((F.col("path").startswith("/") | F.col("path").rlike(r"(?:\A|/)\.{0,2}(?:/|\z)")).cast("int")).alias("bad"))
    known = counted.join(installs.where("install is not null").select("digest", "install"), "digest", "left")
    fault = F.when(F.col("bad") == 1, "path").when(F.col("paths") < F.col("n"), "path twice").when((F.col("n") > 1) & F.col("install").isNull(), "no install script")
    return known.select("digest", fault.alias("fault")).where("fault is not null")


def materialize(files: DataFrame, loose: DataFrame, packed: DataFrame, digest: str, folder: str) -> int:
    """Writes the files of one payload under a folder, each with its execute bit; returns their number.

    The rows are streamed to this machine, since its file system is the destination.
    """
    own = files.where(F.col("digest") == digest)
    if own.isEmpty():
        raise ValueError(f"no object {digest}")
    objects = get(own.select(F.col("object").alias("hash")), loose, packed)
    n = 0
    for r in own.join(objects, own["object"] == objects["hash"]).select("path", "executable", "bytes").toLocalIterator():
        path = os.path.join(folder, r["path"])
        if not os.path.abspath(path).startswith(os.path.abspath(folder) + os.sep):
            raise ValueError(f"{r['path']} is outside of the folder")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(bytes(r["bytes"]))
        os.chmod(path, 0o755 if r["executable"] else 0o644)
        n += 1
    return n


def encode_slot(tag: str, payload: bytes, owner: bytes | None = None) -> bytes:
    """A slot's frame: the tag, the owner's hash for checkpoints, the payload."""
    enc = Encoder().text(tag)
    if owner is not None:
        enc.digest(owner)
    return enc.data(payload).done()


def decode_slot(frame: bytes | None, tag: str, owner: bytes | None = None) -> bytes | None:
    """The payload of a whole frame with this tag and owner, else None."""
    if frame is None:
        return None
    dec = Decoder(frame)
    try:
        if dec.text() != tag or owner is not None and dec.digest() != owner:
            return None
        payload = dec.data()
        dec.end()
    except ValueError:
        return None
    return payload
