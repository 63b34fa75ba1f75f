import pytest

from runlode.operators import ledger, store
from runlode.sources import ledgers

NOW = 10_000_000
BIG = (1 << 64) - 1


def instances(spark, *rows):
    return spark.createDataFrame([(t, "p", "m", o, "worker", s, i, r, c) for t, o, s, i, r, c in rows], ledgers.INSTANCES)


def spend(spark, *rows):
    return spark.createDataFrame([(t, "p", o, r, a, b, c) for t, o, r, a, b, c in rows], ledgers.SPEND)


def D(x):
    from decimal import Decimal

    return Decimal(x)


def test_open_rentals_match_on_tag_and_start(spark):
    i = instances(spark, ("t", "o", "live", "i", D(82_400), NOW - 3_600_000), ("t", "o", "intent", None, D(1), 5))
    s = spend(spark, ("t", "o", D(1), 5, 6, D(7)))
    r = ledger.open_rentals(i, s, NOW).collect()
    assert [(x.started_ms, x.accrued) for x in r] == [(NOW - 3_600_000, 82_400)]


def test_accrual_rounds_up_and_saturates(spark):
    i = instances(spark, ("a", "o", "live", "i", D(1), NOW - 1), ("b", "o", "live", "i", D(5), NOW + 9), ("c", "o", "live", "i", D(BIG), 0))
    got = {x.tag: x.accrued for x in ledger.open_rentals(i, spend(spark), NOW).collect()}
    assert got["a"] == 1 and got["b"] == 0 and got["c"] == BIG


def test_total_saturates(spark):
    s = spend(spark, ("a", "o", D(1), 5, 6, D(BIG)), ("b", "o", D(1), 4, 6, D(BIG)))
    r = ledger.spend_report(instances(spark), s, NOW).first()
    assert (r.total, r.first_ms, r.closed, r.open) == (BIG, 4, 2, 0)


@pytest.mark.parametrize(("cap", "wall", "verdict"), [(100, None, "spend"), (101, None, "within"), (None, NOW - 5, "wall_clock"), (None, NOW - 4, "within"), (100, 1, "spend"), (None, None, "within"), (None, BIG, "within")])
def test_budget(spark, cap, wall, verdict):
    report = ledger.spend_report(instances(spark), spend(spark, ("a", "o", D(1), 5, 6, D(100))), NOW)
    assert ledger.budget_verdict(report, NOW, cap, wall).first().verdict == verdict


def test_machines(spark):
    rows = [("p", "flaky", "lost", "t", 10), ("p", "flaky", "probe_failed", "t", 30), ("p", "fluke", "never_ready", "t", 20)]
    got = {r.machine: (r.incidents, r.lost, r.first_ms, r.last_ms, r.blacklisted) for r in ledger.machine_report(spark.createDataFrame(rows, ledgers.INCIDENTS)).collect()}
    assert got == {"flaky": (2, 1, 10, 30, True), "fluke": (1, 0, 20, 20, False)}


def test_offers(spark):
    nan = float("nan")
    rows = [("b", "m1", "RTX 4090", 1, D(5), 0.9), ("a", "m2", "rtx 4090", 1, D(5), 0.9), ("c", "", "A100", 1, D(1), nan), ("d", "m4", "RTX 3090", 2, D(9), 0.9)]
    offers = spark.createDataFrame(rows, "id string, machine string, gpu_model string, gpu_count long, price decimal(20,0), reliability double")
    ids = lambda c, ex=None: [r.id for r in ledger.select_offers(offers, c, ex).collect()]
    assert ids(ledger.Constraints()) == ["c", "a", "b", "d"]
    assert ids(ledger.Constraints(min_reliability=0.1)) == ["a", "b", "d"]
    assert ids(ledger.Constraints(gpu_models=("4090", "a1"))) == ["c", "a", "b"]
    assert ids(ledger.Constraints(max_price=5, excluded=frozenset({"m1", ""}))) == ["c", "a"]
    gone = spark.createDataFrame([("m2",), ("",)], "machine string")
    assert ids(ledger.Constraints(), gone) == ["c", "b", "d"]


def test_reconcile_table(spark):
    i = instances(spark, ("held", "run", "live", "i1", D(1), 0), ("listed", "o", "live", "i2", D(1), 0), ("probe", "o", "live", "i3", D(1), 0), ("gone", "o", "live", "i4", D(1), 0), ("int", "o", "intent", None, D(1), 0), ("int0", "o", "intent", None, D(1), 0), ("inth", "run", "intent", None, D(1), 0))
    listing = spark.createDataFrame([("i1", "held", D(9)), ("i2", "x", D(9)), ("i5", "int", None)], ledgers.LISTING)
    locked = spark.createDataFrame([("run",)], "owner string")
    gone = spark.createDataFrame([("i4",)], "id string")
    got = {r.tag: (r.verdict, r.instance, r.rate) for r in ledger.reconcile(i, listing, "p", locked, gone).collect()}
    assert got == {"held": ("keep", None, None), "listed": ("destroy", "i2", 9), "probe": ("destroy", "i3", 1), "gone": ("close", None, 1), "int": ("destroy", "i5", 1), "int0": ("close", None, 1), "inth": ("keep", None, None)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, at int, v int")
    new = spark.createDataFrame([("a", 0, 2), ("a", 3, 3)], "k string, at int, v int")
    assert {r.k: r.v for r in ledger.upsert(old, new, ["k"], "at").collect()} == {"a": 3, "b": 1}


def graph(spark):
    m = spark.createDataFrame([("A", "1", "r1"), ("A", "2", "r2"), ("B", "2", "r2"), ("B", "3", "r3"), ("U", "4", "r4")], "search_id string, task_key string, record_hash string")
    r = spark.createDataFrame([(f"r{k}", o) for k in (1, 2, 3, 4) for o in (f"a{k}", "spec")], "record_hash string, object string")
    s = spark.createDataFrame([("A", True), ("B", True), ("U", False)], "search_id string, finalized boolean")
    return s, m, r


def objects(df):
    return sorted(r.object for r in df.collect())


def test_collection_and_removal(spark):
    s, m, r = graph(spark)
    held = r.select("object").distinct().unionByName(m.selectExpr("record_hash as object").distinct())
    live = store.live_objects(s, m, r)
    doomed = store.gc_doomed(held, live)
    assert objects(doomed) == ["a4", "r4"]
    assert [x.task_key for x in store.doomed_index(m, doomed).collect()] == ["4"]
    with pytest.raises(ValueError, match="not finalized"):
        store.removal_plan("A", s, m, r)
    done = s.where("search_id <> 'U'")
    assert objects(store.removal_plan("A", done, m.where("search_id <> 'U'"), r)) == ["a1", "r1"]


def test_sync(spark):
    one = spark.createDataFrame([("1", "a"), ("2", "b")], "task_key string, record string")
    two = spark.createDataFrame([("2", "b"), ("3", "c")], "task_key string, record string")
    assert sorted(r.task_key for r in store.synchronized(one, two).collect()) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="diverge"):
        store.synchronized(one, spark.createDataFrame([("2", "x")], "task_key string, record string"))
    assert store.synchronized(one.limit(0), two).count() == 2


def test_pack_groups(spark):
    rows = [("0" + str(k), size) for k, size in enumerate((4, 5, 3, 20, 1, 1))]
    got = store.pack_groups(spark.createDataFrame(rows, "hash string, size long"), 10).orderBy("pack").collect()
    assert [(r.objects, r.bytes) for r in got] == [(2, 9), (1, 3), (1, 20), (2, 2)]


def test_put_if_absent_and_finalize(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r.k for r in store.put_if_absent(t, new, "k", "v").collect()] == ["b"]
    with pytest.raises(ValueError, match="another value"):
        store.put_if_absent(t, spark.createDataFrame([("a", 2)], "k string, v int"), "k", "v")
    tasks = spark.createDataFrame([("2",), ("1",)], "task_key string")
    index = spark.createDataFrame([("1", "x"), ("2", "y")], "task_key string, record_hash string")
    assert [r.record_hash for r in store.finalize(tasks, index).collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="no record"):
        store.finalize(tasks, index.limit(1))
    with pytest.raises(ValueError, match="twice"):
        store.finalize(tasks.union(tasks), index)


def test_chain_walk_counts_hops_at_a_fixed_point(spark):
    starts = spark.createDataFrame([("c", 1)], "chain string, state int")
    links = spark.createDataFrame([(1, 2), (2, 2)], "state int, next_state int")
    got = store.chain_walk(spark, starts, links, 4).orderBy("segment").collect()
    assert [(r.segment, r.state) for r in got] == [(0, 1), (1, 2), (2, 2), (3, 2)]
