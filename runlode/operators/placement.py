"""Which work runs where: selectors, fleets, bound chains, queues and the programs of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_selectors(selectors: DataFrame, devices: DataFrame, group: str) -> DataFrame:
    """For each (group, select, ord): the class it names, or how it fails.

    A selector names a class exactly or a device by part of its name, whatever the case, and must
    name one class; two of a group that name one class fail, the later one. A group's devices are
    few, so the test joins them all with its selectors.
    """
    d = devices.select(F.col(group).alias("_g"), F.col("class").alias("_class"), F.col("name").alias("_name"))
    named = (F.lower("select") == F.lower("_class")) | F.lower("_name").contains(F.lower("select"))
    met = selectors.join(d, (F.col(group) == F.col("_g")) & named, "left").groupBy(group, "select", "ord").agg(F.countDistinct("_class").alias("classes"), F.min("_class").alias("class"), F.count("_class").alias("members"))
    earlier = F.count(F.when(F.col("classes") == 1, 1)).over(Window.partitionBy(group, "class").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(F.col("classes") == 0, "no device").when(F.col("classes") > 1, F.concat(F.col("classes").cast("string"), F.lit(" devices"))).when(F.col("_earlier") > 0, "taken").otherwise("found")
    return met.withColumn("_earlier", earlier).withColumn("verdict", verdict).select(group, "select", "ord", "verdict", F.when(F.col("verdict") == "found", F.col("class")).alias("class"), F.when(F.col("verdict") == "found", F.col("members")).alias("members"))


def eligibility(bound: Column, device_class: Column, present: Column) -> Column:
    """What a worker of a class does with a chain: bind, run, skip or rebind."""
    return F.when(bound.isNull(), "bind").when(bound == device_class, "run").when(F.array_contains(present, bound), "skip").otherwise("rebind")


def expand_fleet(members: DataFrame, hosts: DataFrame, classes: DataFrame) -> DataFrame:
    """(ord, name, destination, slot): a member names a host, or a class of addresses or rentals.

    hosts: (name, address), the address null if rented. classes: (name, addresses, count). A host
    goes before a class of the same name; a rented host counts as one.
    """
    h = hosts.select(F.col("name"), F.col("address"), F.lit(True).alias("is_host"))
    c = classes.select(F.col("name"), F.col("addresses"), F.col("count"))
    joined = members.join(h, "name", "left").join(c, "name", "left")
    none = F.array(F.lit(None).cast("string"))
    own = F.when(F.col("is_host"), F.array("address")).when(F.col("addresses").isNotNull(), F.col("addresses")).otherwise(F.when(F.col("count") > 0, F.array_repeat(F.lit(None).cast("string"), F.col("count"))).otherwise(F.array().cast("array<string>")))
    return joined.withColumn("_d", F.coalesce(own, none)).select("ord", "name", F.posexplode("_d").alias("slot", "destination"))


def repeated_destinations(expanded: DataFrame) -> DataFrame:
    """Every destination that an earlier member has, the first repeat first; rentals have none."""
    n = F.row_number().over(Window.partitionBy("destination").orderBy("ord", "slot"))
    return expanded.where("destination is not null").withColumn("_n", n).where("_n > 1").drop("_n").orderBy("ord", "slot")


def member_index(devices: DataFrame, group: str, member: int) -> DataFrame:
    """(group, class, idx): the device with a given number, from 0, within its class."""
    n = F.row_number().over(Window.partitionBy(group, "class").orderBy("idx")) - 1
    return devices.withColumn("_n", n).where(F.col("_n") == member).select(group, "class", "idx")


def next_tasks(queue: DataFrame, chains: DataFrame, workers: DataFrame) -> DataFrame:
    """(search_id, class, task, what): the first queued task that each waiting class may take.

    queue: (search_id, ord, task, chain); chains: (chain, bound class); workers: (search_id, class,
    present). Tasks without a chain are free.
    """
    asked = queue.join(chains.select("chain", "bound"), "chain", "left").join(workers, "search_id")
    what = F.when(F.col("chain").isNull(), "run").otherwise(eligibility(F.col("bound"), F.col("class"), F.col("present")))
    return asked.withColumn("what", what).where("what <> 'skip'").groupBy("search_id", "class").agg(F.min_by(F.struct("task", "what"), "ord").alias("t")).select("search_id", "class", "t.task", "t.what")


def refused_programs(last: DataFrame, routed: DataFrame, accept: bool = False) -> DataFrame:
    """Searches whose routed program is not the one last bound; none if a change is accepted."""
    changed = routed.join(last.select("search_id", F.col("digest").alias("bound")), "search_id").where("bound <> digest")
    return changed.limit(0) if accept else changed


def stepped(rows: DataFrame, steps: int) -> DataFrame:
    """(i, step, acc) of rows (i, seed, increment): the increment added ``steps`` times modulo 2^64.

    seed is decimal(20,0); a row without an increment is rejected and has null.
    """
    wide = F.col("seed").cast("decimal(38,0)") + F.col("increment").cast("decimal(10,0)") * F.lit(steps).cast("decimal(10,0)")
    wrapped = F.pmod(wide.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)")
    return rows.select("i", F.lit(steps).cast("long").alias("step"), F.when(F.col("increment") > 0, wrapped).alias("acc"))
