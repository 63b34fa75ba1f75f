"""Queries over rentals, spend, incidents and offers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.functions.scalars import accrued, at_least, saturated, saturating_add

#: Incidents from which on a machine is left out.
STRIKES = 2


def open_rentals(instances: DataFrame, spend: DataFrame, now_ms: int) -> DataFrame:
    """Rentals without a close-out of the same tag and start, charged up to now, intents too."""
    closed = spend.select("owner", "tag", F.col("started_ms").alias("created_ms"))
    held = instances.join(closed, ["owner", "tag", "created_ms"], "left_anti")
    return held.select("owner", "tag", F.col("price_micro_usd_hour").alias("rate"), F.col("created_ms").alias("started_ms"), accrued(F.col("price_micro_usd_hour"), F.lit(now_ms) - F.col("created_ms")).alias("accrued"))


def spend_report(instances: DataFrame, spend: DataFrame, now_ms: int) -> DataFrame:
    """Per owner: closed and open rentals, the earliest start, and the clamped total."""
    rows = spend.select("owner", "started_ms", F.col("cost_micro_usd").alias("cost"), F.lit(1).alias("closed")).unionByName(open_rentals(instances, spend, now_ms).select("owner", "started_ms", F.col("accrued").alias("cost"), F.lit(0).alias("closed")))
    return rows.groupBy("owner").agg(F.sum("closed").alias("closed"), F.count(F.when(F.col("closed") == 0, 1)).alias("open"), F.min("started_ms").alias("first_ms"), saturated(F.sum("cost")).alias("total"))


def budget_verdict(report: DataFrame, now_ms: int, max_spend: int | None, max_wall_clock_ms: int | None) -> DataFrame:
    """Whether each owner may rent: spend that meets its cap goes before a deadline that has come."""
    deadline = saturating_add(F.col("first_ms"), F.lit(str(max_wall_clock_ms)).cast("decimal(20,0)")) if max_wall_clock_ms is not None else F.lit(None).cast("decimal(20,0)")
    spent = F.col("total") >= F.lit(str(max_spend)).cast("decimal(20,0)") if max_spend is not None else F.lit(False)
    verdict = F.when(spent, "spend").when(F.lit(now_ms) >= F.col("deadline_ms"), "wall_clock").otherwise("within")
    return report.withColumn("deadline_ms", deadline).select("owner", "total", "deadline_ms", verdict.alias("verdict"))


def machine_report(incidents: DataFrame) -> DataFrame:
    """Per (provider, machine): incidents by kind, first and last stamp, and whether it is left out."""
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("lost", "never_ready", "probe_failed", "install_failed")]
    counted = incidents.groupBy("provider", "machine").agg(F.count("*").alias("incidents"), *kinds, F.min("occurred_ms").alias("first_ms"), F.max("occurred_ms").alias("last_ms"))
    return counted.withColumn("blacklisted", F.col("incidents") >= STRIKES).orderBy("provider", "machine")


def excluded_machines(incidents: DataFrame, strikes: int = STRIKES) -> DataFrame:
    return incidents.groupBy("provider", "machine").agg(F.count("*").alias("strikes")).where(F.col("strikes") >= strikes)


@dataclass(frozen=True)
class Constraints:
    """What an offer must satisfy; what is None is not judged."""

    gpu_models: tuple[str, ...] = ()
    verified_only: bool = False
    min_gpu_count: int | None = None
    min_vram_mb: int | None = None
    min_cuda: float | None = None
    min_disk_gb: int | None = None
    min_bandwidth_mbps: int | None = None
    min_reliability: float | None = None
    max_price: int | None = None
    excluded: frozenset[str] = field(default_factory=frozenset)

    def column(self) -> Column:
        tests = [F.lit(True)]
        if self.gpu_models:
            model = F.lower("gpu_model")
            any_of = F.lit(False)
            for name in self.gpu_models:
                any_of = any_of | model.contains(name.lower())
            tests.append(any_of)
        if self.verified_only:
            tests.append(F.col("verified"))
        if self.excluded:
            tests.append((F.col("machine") == "") | ~F.col("machine").isin(*self.excluded))
        for name in ("gpu_count", "vram_mb", "cuda", "disk_gb", "bandwidth_mbps", "reliability"):
            if (least := getattr(self, f"min_{name}")) is not None:
                tests.append(at_least(F.col(name), F.lit(least)))
        if self.max_price is not None:
            tests.append(F.col("price") <= F.lit(str(self.max_price)).cast("decimal(20,0)"))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))


def select_offers(offers: DataFrame, constraints: Constraints, excluded: DataFrame | None = None, limit: int | None = None, provider: str | None = None) -> DataFrame:
    """Qualifying offers of one provider, cheapest first, ties by id.

    excluded: machines left out, by name, or with a provider (provider, machine): what is struck at
    another provider is not left out at this one. '' never matches.
    """
    found = offers.where(constraints.column())
    if excluded is not None:
        if provider is None and "provider" in excluded.columns:
            raise ValueError("machines are excluded at one provider")
        here = excluded if provider is None else excluded.where(F.col("provider") == provider)
        found = found.join(here.where("machine <> ''").select("machine").distinct(), "machine", "left_anti")
    ranked = found.orderBy("price", "id")
    return ranked.limit(limit) if limit is not None else ranked


def reconcile(instances: DataFrame, listing: DataFrame, provider: str, locked: DataFrame, gone: DataFrame, workers_only: bool = True) -> DataFrame:
    """(tag, verdict, instance, rate): keep, destroy or close each of the provider's records.

    listing: (id, tag, price) that the provider holds. locked: owners whose search is running. gone:
    ids the provider denies when asked one by one. A live record is looked up by id, an intent by
    tag; a live one that the listing lacks is destroyed at its own rate unless it is gone.
    """
    scope = instances.where(F.col("provider") == provider)
    if workers_only:
        scope = scope.where(F.col("role") == "worker")
    by_id = listing.groupBy("id").agg(F.min(F.struct("tag", "price")).alias("i")).select(F.col("id").alias("instance"), F.col("i.price").alias("id_price"), F.lit(True).alias("by_id"))
    by_tag = listing.groupBy("tag").agg(F.min(F.struct("id", "price")).alias("t")).select("tag", F.col("t.id").alias("tag_id"), F.col("t.price").alias("tag_price"))
    joined = scope.join(by_id, "instance", "left").join(by_tag, "tag", "left").join(locked.select("owner", F.lit(True).alias("locked")).distinct(), "owner", "left").join(gone.select(F.col("id").alias("instance"), F.lit(True).alias("gone")).distinct(), "instance", "left")
    live = F.col("state") == "live"
    found = F.when(live, F.col("by_id").isNotNull() | F.col("gone").isNull()).otherwise(F.col("tag_id").isNotNull())
    verdict = F.when(F.col("locked"), "keep").when(found, "destroy").otherwise("close")
    machine = F.when(verdict == "destroy", F.when(live, F.col("instance")).otherwise(F.col("tag_id")))
    rate = F.when(verdict != "keep", F.coalesce(F.when(verdict == "destroy", F.when(live, F.col("id_price")).otherwise(F.col("tag_price"))), F.col("price_micro_usd_hour")))
    return joined.select("tag", verdict.alias("verdict"), machine.alias("instance"), rate.alias("rate"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key wins; rows of ``changes`` are later than all of ``table``."""
    rows = table.withColumn("_gen", F.lit(0)).unionByName(changes.withColumn("_gen", F.lit(1)))
    late = Window.partitionBy(*keys).orderBy(F.desc("_gen"), F.desc(order))
    return rows.withColumn("_n", F.row_number().over(late)).where("_n = 1").drop("_n", "_gen")


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows of these keys; a key that it lacks is no error."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def close_out(spend: DataFrame, closed: DataFrame) -> DataFrame:
    """The spend ledger with rentals closed; a rental, known by tag and start, is closed once, the first time."""
    new = closed.dropDuplicates(["tag", "started_ms"]).join(spend.select("tag", "started_ms"), ["tag", "started_ms"], "left_anti")
    return spend.unionByName(new.select(*spend.columns))


def usable_devices(devices: DataFrame, group: str) -> DataFrame:
    """Without the processors where a group has any other device."""
    other = F.max((F.col("device_type") != "cpu").cast("int")).over(Window.partitionBy(group))
    return devices.withColumn("_o", other).where((F.col("_o") == 0) | (F.col("device_type") != "cpu")).drop("_o")


def device_members(devices: DataFrame, group: str) -> DataFrame:
    """With ``member``: the number, from 0, of a device within its class."""
    return devices.withColumn("member", (F.row_number().over(Window.partitionBy(group, "class").orderBy("idx")) - 1).cast("int"))


def default_device(devices: DataFrame, group: str, index: int | None = None) -> DataFrame:
    """(group, idx): the first device of the best type, or the one asked for; a group that lacks it is an error."""
    if index is not None:
        asked = devices.groupBy(group).agg(F.max((F.col("idx") == index).cast("int")).alias("_there"))
        there = F.assert_true(F.col("_there") == 1, F.lit(f"no device {index}"))
        return asked.where(there.isNull()).select(group, F.lit(index).alias("idx"))
    rank = F.array_position(F.array(*map(F.lit, ("discrete", "integrated", "virtual", "cpu", "other"))), F.col("device_type"))
    return devices.groupBy(group).agg(F.min_by("idx", F.struct(rank, F.col("idx"))).alias("idx"))


def slots(members: DataFrame, group: str, workers: int) -> DataFrame:
    """Worker slots dealt over each group's members in turn."""
    n = F.count("*").over(Window.partitionBy(group))
    numbered = members.withColumn("_n", n).withColumn("_m", F.row_number().over(Window.partitionBy(group).orderBy("idx")) - 1)
    return numbered.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(workers - 1)))).where("slot % _n = _m").select(group, "slot", "idx")
