"""The logical tables of the engine over the TPC-H-like tables that the driver gives.

Each view has a Spark form and, beside it, the same thing as a DuckDB common table expression, so
that a query and its oracle start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1
#: The instant at which open rentals are charged, and the length of a closed one.
NOW_MS = 904_608_000_000
RENTAL_MS = 36 * 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, from ``events``: k is the number in props, from 0 to 99, user_id picks the search."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    kind = (
        F.when((F.col("event_type") == "signup") & (F.col("k") < 5), "search_started")
        .when((F.col("event_type") == "signup") & (F.col("k") < 8), "search_interrupted")
        .when((F.col("event_type") == "signup") & (F.col("k") < 10), "search_finalized")
        .when((F.col("event_type") == "signup") & (F.col("k") < 12), "search_failed")
        .when(F.col("event_type") == "signup", "queued")
        .when((F.col("event_type") == "view") & (F.col("k") == 98), "checkpoint_degraded")
        .when((F.col("event_type") == "view") & (F.col("k") == 99), "checkpointed")
        .when(F.col("event_type") == "view", "leased")
        .when(F.col("event_type") == "purchase", "committed")
        .when((F.col("event_type") == "error") & (F.col("k") % 10 == 0), "rejected")
        .when((F.col("event_type") == "error") & (F.col("k") % 10 == 1), "faulted")
        .when((F.col("event_type") == "error") & (F.col("k") % 10 == 2), "lease_expired")
        .when((F.col("event_type") == "error") & (F.col("k") % 10 == 3), "retried")
        .when(F.col("event_type") == "error", "failed")
        .when((F.col("event_type") == "click") & (F.col("k") == 50), "chain_rebound")
        .when((F.col("event_type") == "click") & (F.col("k") == 51), "program_bound")
        .when(F.col("event_type") == "click", "worker_bound")
    )
    started = kind == "search_started"
    bound = kind == "worker_bound"
    rebound = kind == "chain_rebound"
    named = ~kind.isin("search_started", "search_interrupted", "search_finalized", "worker_bound", "chain_rebound", "program_bound")
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("search_id"),
        F.col("event_id").alias("seq"),
        # Free of the session's time zone: the stamps have none.
        F.expr("cast(floor(cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6)) * 1000) as bigint)").alias("ts_ms"),
        kind.alias("event"),
        F.when(named, F.format_string("t%02d", F.col("k") % 25)).alias("task"),
        F.when(bound | kind.isin("leased", "lease_expired", "checkpointed"), (F.col("k") % 25 % 4).cast("long")).alias("worker"),
        F.when(bound, F.concat(F.lit("d"), (F.col("k") % 3).cast("string"))).alias("device"),
        F.when(bound, F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("k") % 4).cast("string")))).alias("host"),
        F.when(bound, F.concat(F.lit("v"), (F.col("k") % 5).cast("string"))).alias("driver"),
        F.when(kind.isin("leased", "committed", "failed", "rejected", "faulted"), (F.col("k") % 3).cast("int")).alias("attempt"),
        F.when(kind == "retried", (F.col("k") % 3 + 1).cast("int")).alias("next_attempt"),
        F.when(kind == "lease_expired", F.col("k").cast("long") * 100).alias("elapsed_ms"),
        F.when(kind.isin("faulted", "checkpoint_degraded"), F.concat(F.lit("e"), F.col("k").cast("string"))).alias("error"),
        F.when(kind == "program_bound", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string"))).alias("digest"),
        F.when(rebound, F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("chain"),
        F.when(rebound, F.lit("d0")).alias("from"),
        F.when(rebound, F.lit("d1")).alias("to"),
        F.when(kind.isin("committed", "failed", "rejected"), F.array(F.struct(F.lit("value").alias("name"), F.floor("value").cast("double").alias("value")))).alias("stats"),
        F.when(kind == "committed", F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("record"),
        F.when(kind.isin("failed", "rejected", "search_failed"), F.concat(F.lit("k"), F.col("k").cast("string"))).alias("reason"),
        F.when(started, F.col("k").cast("long") + 20).alias("tasks"),
        F.when(started | (kind == "search_finalized"), F.col("k").cast("long")).alias("restored"),
    )


JOURNAL = """
e AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), ek AS (
  SELECT *, CASE WHEN event_type = 'signup' AND k < 5 THEN 'search_started' WHEN event_type = 'signup' AND k < 8 THEN 'search_interrupted' WHEN event_type = 'signup' AND k < 10 THEN 'search_finalized' WHEN event_type = 'signup' AND k < 12 THEN 'search_failed' WHEN event_type = 'signup' THEN 'queued'
    WHEN event_type = 'view' AND k = 98 THEN 'checkpoint_degraded' WHEN event_type = 'view' AND k = 99 THEN 'checkpointed' WHEN event_type = 'view' THEN 'leased' WHEN event_type = 'purchase' THEN 'committed'
    WHEN event_type = 'error' AND k % 10 = 0 THEN 'rejected' WHEN event_type = 'error' AND k % 10 = 1 THEN 'faulted' WHEN event_type = 'error' AND k % 10 = 2 THEN 'lease_expired' WHEN event_type = 'error' AND k % 10 = 3 THEN 'retried' WHEN event_type = 'error' THEN 'failed'
    WHEN event_type = 'click' AND k = 50 THEN 'chain_rebound' WHEN event_type = 'click' AND k = 51 THEN 'program_bound' WHEN event_type = 'click' THEN 'worker_bound' END AS event FROM e
), journal AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS search_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event,
    CASE WHEN event NOT IN ('search_started', 'search_interrupted', 'search_finalized', 'worker_bound', 'chain_rebound', 'program_bound') THEN printf('t%02d', k % 25) END AS task,
    CASE WHEN event IN ('worker_bound', 'leased', 'lease_expired', 'checkpointed') THEN CAST(k % 25 % 4 AS BIGINT) END AS worker,
    CASE WHEN event = 'worker_bound' THEN 'd' || (k % 3) END AS device,
    CASE WHEN event = 'worker_bound' THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'h' || (k % 4) END END AS host,
    CASE WHEN event = 'worker_bound' THEN 'v' || (k % 5) END AS driver,
    CASE WHEN event IN ('leased', 'committed', 'failed', 'rejected', 'faulted') THEN k % 3 END AS attempt, CASE WHEN event = 'retried' THEN k % 3 + 1 END AS next_attempt, CASE WHEN event = 'lease_expired' THEN k * 100 END AS elapsed_ms,
    CASE WHEN event IN ('faulted', 'checkpoint_degraded') THEN 'e' || k END AS error, CASE WHEN event = 'program_bound' THEN 'g' || (event_id % 3) END AS digest, CASE WHEN event = 'chain_rebound' THEN 'c' || (event_id % 7) END AS chain,
    CASE WHEN event IN ('committed', 'failed', 'rejected') THEN floor(value) END AS stat,
    CASE WHEN event = 'committed' THEN 'r' || event_id END AS record,
    CASE WHEN event IN ('failed', 'rejected', 'search_failed') THEN 'k' || k END AS reason,
    CASE WHEN event = 'search_started' THEN k + 20 END AS tasks,
    CASE WHEN event IN ('search_started', 'search_finalized') THEN k END AS restored
  FROM ek WHERE event IS NOT NULL
)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rentable machines, from ``part``; one in seven has a reliability that is not a number."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        F.format_string("o%06d", key).alias("id"),
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("m"), key.cast("string"))).alias("machine"),
        F.col("p_type").alias("gpu_model"),
        F.col("p_size").cast("long").alias("gpu_count"),
        (F.col("p_size").cast("long") * 1024).alias("vram_mb"),
        (F.lit(11.0) + (key % 3).cast("double")).alias("cuda"),
        F.round(F.col("p_retailprice") * 1_000_000).cast("decimal(20,0)").alias("price"),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5) + (key % 50).cast("double") / 100).alias("reliability"),
        (key % 4 != 0).alias("verified"),
        (key % 500).cast("long").alias("disk_gb"),
        (key % 900).cast("long").alias("bandwidth_mbps"),
    )


OFFERS = """
offers AS (
  SELECT printf('o%06d', p_partkey) AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'm' || p_partkey END AS machine, p_type AS gpu_model, CAST(p_size AS BIGINT) AS gpu_count,
    CAST(p_size AS BIGINT) * 1024 AS vram_mb, 11.0::DOUBLE + (p_partkey % 3) AS cuda, CAST(round(p_retailprice * 1000000) AS DECIMAL(20,0)) AS price,
    CASE WHEN p_partkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE 0.5::DOUBLE + (p_partkey % 50)::DOUBLE / 100 END AS reliability, p_partkey % 4 <> 0 AS verified, p_partkey % 500 AS disk_gb, p_partkey % 900 AS bandwidth_mbps FROM part
)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of machines, from the returned first lines of ``lineitem``."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1")
    kind = F.element_at(F.array(*map(F.lit, INCIDENT_KINDS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 2).cast("string")).alias("provider"),
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("machine"),
        kind.alias("kind"),
        F.concat(F.lit("g"), F.col("l_orderkey").cast("string")).alias("tag"),
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("occurred_ms"),
    )


INCIDENT_KINDS = ("lost", "never_ready", "probe_failed", "install_failed")
INCIDENTS = """
incidents AS (
  SELECT 'p' || (l_partkey % 2) AS provider, 'm' || l_partkey AS machine, ['lost', 'never_ready', 'probe_failed', 'install_failed'][l_suppkey % 4 + 1] AS kind, 'g' || l_orderkey AS tag,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000 AS occurred_ms FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1
)"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental records, from ``orders``; the state of one in three is an intent."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("g"), key.cast("string")).alias("tag"),
        F.concat(F.lit("p"), (key % 2).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (key % 97).cast("string")).alias("machine"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.element_at(F.array(F.lit("worker"), F.lit("orchestrator"), F.lit("exec")), (key % 5 % 3 + 1).cast("int")).alias("role"),
        F.when(key % 3 == 0, "intent").otherwise("live").alias("state"),
        F.when(key % 3 != 0, F.concat(F.lit("i"), key.cast("string"))).alias("instance"),
        F.round(F.col("o_totalprice") * 1000).cast("decimal(20,0)").alias("price_micro_usd_hour"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("created_ms"),
        F.col("o_orderstatus").alias("_status"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rentals: those of finished orders, closed after a fixed time and charged for it."""
    closed = instances(spark, sf_dir).where("_status = 'F'")
    hours = RENTAL_MS // 3_600_000
    return closed.select("tag", "provider", "owner", "price_micro_usd_hour", F.col("created_ms").alias("started_ms"), (F.col("created_ms") + RENTAL_MS).alias("ended_ms"), (F.col("price_micro_usd_hour") * hours).cast("decimal(20,0)").alias("cost_micro_usd"))


INSTANCES = f"""
instances AS (
  SELECT 'g' || o_orderkey AS tag, 'p' || (o_orderkey % 2) AS provider, 'm' || (o_orderkey % 97) AS machine, CAST(o_custkey AS VARCHAR) AS owner, ['worker', 'orchestrator', 'exec'][o_orderkey % 5 % 3 + 1] AS role,
    CASE WHEN o_orderkey % 3 = 0 THEN 'intent' ELSE 'live' END AS state, CASE WHEN o_orderkey % 3 <> 0 THEN 'i' || o_orderkey END AS instance, CAST(round(o_totalprice * 1000) AS DECIMAL(20,0)) AS price_micro_usd_hour,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS created_ms, o_orderstatus AS st FROM orders
), spend AS (
  SELECT tag, provider, owner, price_micro_usd_hour, created_ms AS started_ms, created_ms + {RENTAL_MS} AS ended_ms, CAST(price_micro_usd_hour * {RENTAL_MS // 3_600_000} AS DECIMAL(20,0)) AS cost_micro_usd FROM instances WHERE st = 'F'
)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the provider says it holds: (id, tag, price)."""
    return instances(spark, sf_dir).where("substring(tag, 2) % 4 <> 0").select(F.coalesce("instance", F.concat(F.lit("i"), F.substring("tag", 2, 20))).alias("id"), "tag", F.when(F.substring("tag", 2, 20).cast("long") % 5 != 0, F.col("price_micro_usd_hour") + 1).cast("decimal(20,0)").alias("price"))


LISTING = """
listing AS (
  SELECT coalesce(instance, 'i' || substr(tag, 2)) AS id, tag, CASE WHEN CAST(substr(tag, 2) AS BIGINT) % 5 <> 0 THEN CAST(price_micro_usd_hour + 1 AS DECIMAL(20,0)) END AS price FROM instances WHERE CAST(substr(tag, 2) AS BIGINT) % 4 <> 0
)"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, finalized) from the customers of ``orders``."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search_id")).distinct().withColumn("finalized", F.col("search_id") % 3 != 0)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, task_key, record_hash), one row for each order."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("task_key"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_hash"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_hash, object): each line is an artifact of its order's record and names a shared spec."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    own = F.concat(F.lit("a"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return li.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("record_hash"), F.explode(F.array(own, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("object")).distinct()


STORE = """
searches AS (SELECT DISTINCT o_custkey AS search_id, o_custkey % 3 <> 0 AS finalized FROM orders),
manifests AS (SELECT o_custkey AS search_id, o_orderkey AS task_key, 'r' || o_orderkey AS record_hash FROM orders),
refs AS (
  SELECT DISTINCT 'r' || l_orderkey AS record_hash, unnest(['a' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey]) AS object FROM lineitem
)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand, current, previous): 16 cells of 4 channels each, from ``embeddings`` and the row before."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("previous"))
    return e.join(before, "vec_id").select(F.col("vec_id").alias("cand"), F.col("embedding").alias("current"), "previous")


GRIDS = """
grids AS (SELECT a.vec_id AS cand, a.embedding AS current, b.embedding AS previous FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1)"""
