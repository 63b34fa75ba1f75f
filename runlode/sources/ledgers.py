"""Ledgers, devices, offers, payloads and packs as tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

_MONEY = "decimal(20,0)"
INSTANCES = f"tag string, provider string, machine string, owner string, role string, state string, instance string, price_micro_usd_hour {_MONEY}, created_ms long"
SPEND = f"tag string, provider string, owner string, price_micro_usd_hour {_MONEY}, started_ms long, ended_ms long, cost_micro_usd {_MONEY}"
INCIDENTS = "provider string, machine string, kind string, tag string, occurred_ms long"
DEVICES = "class string, name string, device_type string, idx int"
LISTING = f"id string, tag string, price {_MONEY}"


def read_ledger(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of a folder with one JSON file a row, named for the row's key; another name is an error.

    key: a SQL expression over the columns. Every field must parse.
    """
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select("*", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1).alias("_name"))
    ok = F.assert_true(F.col("_name") == F.expr(key).cast("string"), F.lit("a ledger file is not named for its row"))
    return rows.where(ok.isNull()).drop("_name")


def write_ledger(table: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that the rows touch, so a repeated write changes nothing."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def parse_devices(lines: DataFrame) -> DataFrame:
    """Devices from rows (value): one JSON object a line; blank lines are skipped, others must parse."""
    got = lines.where(F.trim("value") != "").select(F.from_json("value", DEVICES, {"mode": "FAILFAST"}).alias("d"))
    return got.select("d.*")


def normalize_offers(rows: DataFrame) -> DataFrame:
    """Offers from marketplace rows; a row without a finite, non-negative price is left out."""
    micro = F.round(F.col("dph_total") * 1_000_000)
    priced = F.col("dph_total").isNotNull() & ~F.isnan("dph_total") & (F.col("dph_total") >= 0) & (F.col("dph_total") < float("inf"))
    return rows.where(priced).select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.col("machine_id").cast("string"), F.lit("")).alias("machine"),
        F.coalesce("gpu_name", F.lit("")).alias("gpu_model"),
        F.coalesce("num_gpus", F.lit(0)).cast("long").alias("gpu_count"),
        F.coalesce("gpu_ram", F.lit(0)).cast("long").alias("vram_mb"),
        F.coalesce("cuda_max_good", F.lit(0.0)).cast("double").alias("cuda"),
        micro.cast(_MONEY).alias("price"),
        F.coalesce("reliability", F.lit(0.0)).cast("double").alias("reliability"),
        F.coalesce(F.col("verification") == "verified", F.lit(False)).alias("verified"),
        F.coalesce("disk_space", F.lit(0)).cast("long").alias("disk_gb"),
        F.coalesce("inet_down", F.lit(0)).cast("long").alias("bandwidth_mbps"),
        F.col("geolocation").alias("location"),
    )


def query_price(micro: int) -> float:
    """The price bound sent to a marketplace, in dollars: rounded up to a cent, so never too narrow."""
    return -(-micro // 10_000) / 100


OFFER_ROWS = "id long, machine_id long, gpu_name string, num_gpus long, gpu_ram long, cuda_max_good double, dph_total double, reliability double, verification string, disk_space double, inet_down double, geolocation string"


class _OfferReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            yield f  # every test is repeated by Spark: what a marketplace returns may be wider

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        test = {"EqualTo": lambda a, b: a == b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThanOrEqual": lambda a, b: a <= b}
        with open(self.path) as f:
            for line in f:
                row = json.loads(line)
                if all(row.get(c) is not None and test[op](row[c], v) for c, op, v in self.tests):
                    yield tuple(row.get(c.name) for c in self.schema.fields)


class OfferSource(DataSource):
    """``format("runlode_offers")`` with option path: recorded marketplace rows, tests pushed down."""

    @classmethod
    def name(cls) -> str:
        return "runlode_offers"

    def schema(self) -> str:
        return OFFER_ROWS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _OfferReader(self.options["path"], schema)


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfferSource)
    return normalize_offers(spark.read.format("runlode_offers").option("path", path).load())


def ingest(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """(path, hash, bytes) of the files under a folder, sorted by path; a larger file is an error."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = F.assert_true(F.col("length") <= max_bytes, F.lit("a payload file is too large"))
    relative = F.regexp_replace("path", f"^.*?{root.rsplit('/', 1)[-1]}/", "")
    return files.where(small.isNull()).select(relative.alias("path"), F.sha2("content", 256).alias("hash"), F.col("content").alias("bytes")).orderBy("path")


def write_pack(objects: DataFrame, path: str, parts: int = 8) -> None:
    """Objects (hash, bytes) once each, range-dealt and sorted by hash, compressed."""
    objects.dropDuplicates(["hash"]).repartitionByRange(parts, "hash").sortWithinPartitions("hash").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_pack(spark: SparkSession, path: str, hash_of: Column | None = None) -> DataFrame:
    """The objects of a pack; bytes that do not have their hash are an error."""
    made = hash_of if hash_of is not None else F.sha2("bytes", 256)
    rows = spark.read.parquet(path)
    return rows.where(F.assert_true(made == F.col("hash"), F.lit("an object does not have its hash")).isNull())


def get_object(spark: SparkSession, path: str, key: str) -> bytes | None:
    """One object's bytes, by a filter that Parquet statistics narrow to a file."""
    row = spark.read.parquet(path).where(F.col("hash") == key).select("bytes").first()
    if row is None:
        return None
    data = bytes(row["bytes"])
    if hashlib.sha256(data).hexdigest() != key:
        raise ValueError("an object does not have its hash")
    return data
