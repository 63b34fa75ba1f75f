import pytest
from pyspark.sql import functions as F

from runlode.functions import domains
from runlode.operators import journal, placement
from runlode.plans import render
from runlode.streaming import status
from tests.test_journal import bound, committed, ev, leased, log, started


def test_selectors(spark):
    devices = spark.createDataFrame([("h", "c1", "RTX 4090", 0), ("h", "c1", "RTX 4090", 1), ("h", "c2", "RTX 3090", 2)], "host string, class string, name string, idx int")
    asked = [("h", s, k) for k, s in enumerate(("C1", "rtx", "4090", "amd", "3090"))]
    got = placement.resolve_selectors(spark.createDataFrame(asked, "host string, select string, ord int"), devices, "host")
    assert {r.select: (r.verdict, r["class"], r.members) for r in got.collect()} == {"C1": ("found", "c1", 2), "rtx": ("2 devices", None, None), "4090": ("taken", None, None), "amd": ("no device", None, None), "3090": ("found", "c2", 1)}


def test_eligibility(spark):
    rows = [(None, "bind"), ("a", "run"), ("b", "skip"), ("z", "rebind")]
    got = spark.createDataFrame(rows, "bound string, want string").select("want", placement.eligibility(F.col("bound"), F.lit("a"), F.array(F.lit("a"), F.lit("b"))).alias("is")).collect()
    assert all(r.want == r["is"] for r in got)


def test_fleet(spark):
    hosts = spark.createDataFrame([("h", "1.1.1.1"), ("rented", None)], "name string, address string")
    classes = spark.createDataFrame([("c", ["2.2.2.2", "1.1.1.1"], None), ("r", None, 2)], "name string, addresses array<string>, count int")
    members = spark.createDataFrame(list(enumerate(("h", "c", "r", "rented"))), "ord int, name string")
    out = placement.expand_fleet(members, hosts, classes)
    assert [(r.name, r.destination) for r in out.orderBy("ord", "slot").collect()] == [("h", "1.1.1.1"), ("c", "2.2.2.2"), ("c", "1.1.1.1"), ("r", None), ("r", None), ("rented", None)]
    assert [(r.name, r.slot) for r in placement.repeated_destinations(out).collect()] == [("c", 1)]


def test_stepper(spark):
    from decimal import Decimal

    rows = spark.createDataFrame([(1, Decimal((1 << 64) - 1), 3), (2, Decimal(5), 0)], "i int, seed decimal(20,0), increment int")
    got = {r.i: r.acc for r in placement.stepped(rows, 10).collect()}
    assert got == {1: 29, 2: None}


def test_programs(spark):
    last = spark.createDataFrame([("s", "a"), ("t", "b")], "search_id string, digest string")
    now = spark.createDataFrame([("s", "x"), ("t", "b"), ("new", "c")], "search_id string, digest string")
    assert [r.search_id for r in placement.refused_programs(last, now).collect()] == ["s"]
    assert placement.refused_programs(last, now, accept=True).count() == 0


def test_narration(spark):
    j = log(spark, started(0, 5, 3), ev(1, "queued", "aa"), leased(2, "aa", 1), ev(3, "failed", "aa", reason="x", attempt=0), committed(4, "a" * 20), started(5, 5), bound(6))
    got = [r.line for r in render.narrate(j).orderBy("seq").collect()]
    assert got == ["resuming: 3/5 committed, 2 outstanding", "task aa started (worker 1)", "failed aa (attempt 0): x", "committed 4/5  " + "a" * 12, "started: 5 tasks"]
    assert "started (worker" not in " ".join(r.line for r in render.narrate(j, minimal=True).collect())


def test_blocks(spark):
    j = log(spark, started(0, 5), bound(0), leased(1, "aa"), committed(2, "aa"))
    block = render.status_block(journal.status_counts(j), journal.status_composition(j))
    assert "committed            1" in block and block.endswith("d ×1")
    registry = spark.createDataFrame([("s",), ("new",)], "search_id string")
    lines = render.searches_block(journal.search_summaries(registry, j)).split("\n")
    assert len(lines) == 3 and lines[1].split() == ["new", "in_progress", "0/0"] and lines[2].endswith("1/5")
    assert render.searches_block(journal.search_summaries(registry.limit(0), j)) == "this store holds no search"


def test_lost_reader():
    class Gone:
        def write(self, _):
            raise BrokenPipeError

    assert render.write_lines(["x"], Gone()) is False


def test_domains(spark):
    def execute(spec, params, seed, attempt, state):
        kind = spec[0]
        if kind == 0:
            return domains.Rejected("zero")
        if kind == 1 and attempt < 1:
            return domains.Failed("once")
        if kind == 2:
            return domains.Failed("always")
        if kind == 3:
            raise RuntimeError("boom")
        return domains.Completed({"b": b"2", "a": bytes([kind])}, {"seed": seed})

    domains.REGISTRY.pop("demo", None)
    domains.register(domains.Domain("demo", {"v": "1"}, execute, lambda seed, params: [bytes([k]) for k in range(seed)]))
    with pytest.raises(ValueError, match="already"):
        domains.register(domains.REGISTRY["demo"])
    specs = domains.generated(spark, "demo", 5, b"")
    assert [bytes(r.spec) for r in specs.orderBy("i").collect()] == [bytes([k]) for k in range(5)]
    tasks = specs.select("i", "spec", F.lit(b"").alias("params"), F.lit(7).alias("seed"), F.lit(None).cast("binary").alias("input_state"))
    got = {r.i: (r.attempts, r.outcome, r.reason) for r in domains.evaluate(tasks, "demo").collect()}
    assert got == {0: (1, "rejected", "zero"), 1: (2, "completed", None), 2: (3, "failed", "always"), 3: (1, "rejected", "panic: boom"), 4: (1, "completed", None)}


def test_lease_timeouts(spark, tmp_path):
    schema = "search_id string, seq long, event string, task string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put("a", [("s", 0, "leased", "late"), ("s", 1, "leased", "done"), ("s", 2, "committed", "done")])
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = status.lease_timeouts(stream, 1000).writeStream.format("memory").queryName("timeouts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        import time

        for _ in range(60):
            time.sleep(0.5)
            rows = [(r.task, r.event) for r in spark.sql("select * from timeouts").collect()]
            if rows:
                break
    finally:
        query.stop()
    assert rows == [("late", "lease_expired"), ("late", "failed")]
