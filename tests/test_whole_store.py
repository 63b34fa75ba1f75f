"""The store on disk, slots, payloads, the follow stream, supervision, reports and the whole configuration."""

import hashlib
import io
import json
import os
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from runlode.functions import scalars as fn
from runlode.operators import journal, ledger, objects, store
from runlode.plans import render
from runlode.sources import journal as src
from runlode.sources import searchfile
from runlode.streaming import feed, supervise


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def forms(spark, loose, packed):
    made = lambda rows: spark.createDataFrame([(digest(b) if good else "0" * 64, bytearray(b)) for b, good in rows], "hash string, bytes binary")
    return made(loose), made(packed)


def test_objects_are_read_from_either_form_and_verified(spark):
    loose, packed = forms(spark, [(b"a", True), (b"bad", False)], [(b"b", True), (b"a", True)])
    ask = lambda *hs: spark.createDataFrame([(h,) for h in hs], "hash string")
    assert {bytes(r.bytes) for r in objects.get(ask(digest(b"a"), digest(b"b")), loose, packed).collect()} == {b"a", b"b"}
    assert {r.hash: r.present for r in objects.present(ask(digest(b"a"), "x"), loose, packed).collect()} == {digest(b"a"): True, "x": False}
    assert objects.held_objects(loose, packed).count() == 3
    for wrong in ("x", "0" * 64):
        with pytest.raises(Exception, match="no object|does not have its hash"):
            objects.get(ask(wrong), loose, packed).collect()


def test_pack_faults(spark):
    rows = [("p", 0, "a", 0, 5), ("p", 1, "b", 5, 0), ("p", 2, "b", 5, 1), ("p", 3, "c", 7, 1), ("p", 4, "d", 8, -1), ("q", 0, "z", 1, 1)]
    got = objects.pack_faults(spark.createDataFrame(rows, "pack string, position int, hash string, start long, length long")).collect()
    assert sorted((r.pack, r.position, r.fault) for r in got) == [("p", 2, "not ascending"), ("p", 3, "gap or overlap"), ("p", 4, "negative length"), ("q", 0, "gap or overlap")]


def test_compaction_removes_duplicates_without_packing_them(spark):
    loose = spark.createDataFrame([("0a", 6, 4), ("0b", 6, 6), ("0c", 1, 1), ("1d", 99, 50)], "hash string, size long, stored long")
    packs, report = objects.compaction(loose, spark.createDataFrame([("0c",)], "hash string"), cap=10)
    assert sorted((r.shard, r.pack, r.objects, r.bytes) for r in packs.collect()) == [(0, 0, 1, 6), (0, 1, 1, 6), (1, 0, 1, 99)]
    assert report.first().asDict() == {"objects_packed": 3, "packs_written": 3, "loose_removed": 4, "raw_bytes": 111, "stored_bytes": 60}


def test_slots_are_latest_only_and_damage_reads_as_nothing(spark):
    kind = "search_id string, slot int, owner string, payload string"
    slots = spark.createDataFrame([("s", 0, "t0", "old"), ("s", 1, "t9", "other")], kind)
    writes = spark.createDataFrame([("s", 0, "t1", "a", 1), ("s", 0, "t1", "b", 2), ("s", 2, None, None, 1)], kind + ", at long")
    now = objects.save_slots(slots, writes, ["search_id", "slot"], "at")
    tasks = spark.createDataFrame([("s", 0, "t1"), ("s", 1, "t1"), ("s", 2, "t2"), ("s", 3, "t3")], "search_id string, slot int, task_key string")
    assert {r.slot: r.payload for r in objects.load_checkpoints(now, tasks).collect()} == {0: "b", 1: None, 2: None, 3: None}
    owner = bytes(range(32))
    frame = objects.encode_slot(objects.CHECKPOINT_TAG, b"state", owner)
    assert objects.decode_slot(frame, objects.CHECKPOINT_TAG, owner) == b"state"
    for torn in (None, b"", frame[:-1], frame + b"x", frame.replace(b"state", b"stat")):
        assert objects.decode_slot(torn, objects.CHECKPOINT_TAG, owner) is None
    assert objects.decode_slot(frame, objects.CHECKPOINT_TAG, bytes(32)) is None and objects.decode_slot(frame, objects.PLACEMENT_TAG, owner) is None
    placed = spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("s", None, "y")], "search_id string, chain long, payload string")
    assert [(r.chain, r.payload) for r in objects.chain_bindings(placed).collect()] == [(1, "x")]


def test_payloads(spark, tmp_path):
    loose, packed = forms(spark, [(b"#!run", True)], [(b"data", True)])
    rows = [("d", "bin/run", True, digest(b"#!run")), ("d", "data.txt", False, digest(b"data"))]
    files = spark.createDataFrame([*rows, ("e", "x", False, "h"), ("e", "x", False, "h"), ("f", "../x", False, "h"), ("g", "a", False, "h"), ("g", "b", False, "h")], "digest string, path string, executable boolean, object string")
    installs = spark.createDataFrame([("d", "run.sh"), ("e", "i"), ("f", "i")], "digest string, install string")
    assert {r.digest: r.fault for r in objects.payload_faults(files, installs).collect()} == {"e": "path twice", "f": "path", "g": "no install script"}
    assert objects.payload_closure(files.where("digest = 'd'")).count() == 3
    assert objects.materialize(files, loose, packed, "d", str(tmp_path / "out")) == 2
    assert (tmp_path / "out/data.txt").read_bytes() == b"data" and os.access(tmp_path / "out/bin/run", os.X_OK) and not os.access(tmp_path / "out/data.txt", os.X_OK)
    with pytest.raises(ValueError, match="no object"):
        objects.materialize(files, loose, packed, "zz", str(tmp_path))


def test_partial_replicas_need_three_parts_only(spark):
    kind = "task_key string, spec string, params string, environment string, input_state string, artifacts array<string>"
    records = spark.createDataFrame([("t", "s", "p", "e", "i", ["a"])], kind)
    held = spark.createDataFrame([("s",), ("p",), ("e",)], "object string")
    assert objects.commit_partial(records, held).count() == 1
    assert sorted(r.part for r in objects.replica_faults(records, held, whole=True).collect()) == ["artifact", "input_state"]
    with pytest.raises(ValueError, match="not held"):
        objects.commit_partial(records, held.where("object <> 'p'"))


def test_a_long_log_is_numbered_over_its_splits(spark, tmp_path):
    lines = [json.dumps({"ts_ms": k, "event": "queued", "task": "é" * (k % 5)}) for k in range(4000)]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines) + "\n{torn", encoding="utf-8")
    (tmp_path / "s2.jsonl").write_text(lines[0] + "\r\n" + lines[1] + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = src.read_lines(spark, str(tmp_path / "*.jsonl")).orderBy("search_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = (tmp_path / "s1.jsonl").read_bytes()
    first = [r for r in rows if r.search_id == "s1"]
    assert [r.line for r in first] == lines and [r.seq for r in first] == list(range(4000))
    assert all(raw[r.offset : r.offset + len(r.line.encode())] == r.line.encode() for r in first)
    assert [(r.seq, r.line[-1]) for r in rows if r.search_id == "s2"] == [(0, "\r"), (1, "}")]
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\xfe\n")
    with pytest.raises(Exception, match="UTF-8"):
        src.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()


@pytest.mark.parametrize("line", ["{}", '{"event":"nosuch","ts_ms":1}', '{"event":"queued"}', '{"ts_ms":1}', "x"])
def test_strict_reading_is_strict(spark, line):
    lines = spark.createDataFrame([("s", 0, 0, line)], src.LINES)
    with pytest.raises(Exception, match="no event|MALFORMED|PARSE"):
        src.parse(lines).collect()
    assert src.parse(lines, strict=False).count() == 0


def test_events_come_back_from_their_lines(spark):
    lines = ['{"ts_ms":5,"event":"committed","task":"t","record":"r","stats":[{"name":"a","value":1.5},{"name":"b","value":null}]}', '{"ts_ms":6,"event":"search_started","search":"s","tasks":3,"committed":1}']
    events = src.parse(spark.createDataFrame([("s", k, 0, x) for k, x in enumerate(lines)], src.LINES))
    assert [json.loads(r.line) for r in src.to_lines(events).orderBy("seq").collect()] == [{**json.loads(lines[0]), "stats": [{"name": "a", "value": 1.5}, {"name": "b"}]}, json.loads(lines[1])]


def test_numbers_have_no_exponents(spark):
    values = [5.0, 0.5, 1e-4, 1e25, 1.5e22, 1e-20, 1.25e-7, 123456789012345680000.0, -3e21, float("inf"), -float("inf"), float("nan"), 0.0, 1e7]
    said = ["5", "0.5", "0.0001", "1" + "0" * 25, "15" + "0" * 21, "0." + "0" * 19 + "1", "0.000000125", "123456789012345680000", "-3" + "0" * 21, "inf", "-inf", "NaN", "0", "10000000"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r.s for r in rows.select("k", fn.number(F.col("v")).alias("s")).orderBy("k").collect()] == said


def test_names_are_whole_texts(spark):
    rows = spark.createDataFrame([("abc",), ("abc\n",), ("a:b",), ("",), ("f" * 64,), ("f" * 64 + "\n",)], "x string")
    got = rows.select(fn.valid_name(F.col("x")), fn.valid_tag(F.col("x")), fn.valid_class(F.col("x")), fn.valid_owner(F.col("x")), fn.valid_key(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False, False), (False,) * 5, (False, False, True, False, False), (False,) * 5, (True,) * 5, (False,) * 5]


def test_draws_in_steps_are_the_draws(spark):
    rows = spark.range(50).select((F.col("id") * 7 - 3).alias("i"), F.lit(2).alias("k"))
    got = fn.with_draws(rows, 42, "i", "k", "w").select("i", fn.hex64(F.col("w")).alias("w")).collect()
    assert all(int(r.w, 16) == fn.draw_int(fn.derive_int(42, r.i & (1 << 64) - 1), 2) for r in got)


def test_strikes_count_at_their_provider(spark):
    offers = spark.createDataFrame([("a", "m1", D(5)), ("b", "m2", D(6))], "id string, machine string, price decimal(20,0)")
    struck = spark.createDataFrame([("p0", "m1"), ("p1", "m2")], "provider string, machine string")
    ids = lambda p: [r.id for r in ledger.select_offers(offers, ledger.Constraints(), struck, provider=p).collect()]
    assert ids("p0") == ["b"] and ids("p1") == ["a"] and ids("p2") == ["a", "b"]
    with pytest.raises(ValueError, match="provider"):
        ledger.select_offers(offers, ledger.Constraints(), struck)


def test_a_rental_is_closed_once(spark):
    kind = "tag string, started_ms long, cost long"
    ledger_, closed = spark.createDataFrame([("a", 1, 5)], kind), spark.createDataFrame([("a", 1, 9), ("a", 2, 7), ("a", 2, 7)], kind)
    once = ledger.close_out(ledger_, closed)
    assert sorted(map(tuple, once.collect())) == [("a", 1, 5), ("a", 2, 7)] == sorted(map(tuple, ledger.close_out(once, closed).collect()))


def test_search_lookup_and_absences(spark):
    log = spark.createDataFrame([("s1", 0, "search_started", None, None, 4)], "search_id string, seq long, event string, task string, reason string, tasks long")
    with pytest.raises(journal.NoStore):
        journal.log_of(None, "s1")
    with pytest.raises(journal.NeverStarted):
        journal.log_of(log, "s2")
    ids = spark.createDataFrame([("s1",), ("s2",)], "search_id string")
    assert {r.search_id: (r.tasks, r.state) for r in journal.seeded_status(log, ids).collect()} == {"s1": (4, "in_progress"), "s2": (0, "in_progress")}
    assert journal.seeded_status(None, ids).agg(F.sum("tasks")).first()[0] == 0


def test_follow_stream():
    hello = feed.Frame(feed.HELLO, search=bytes(range(32)), format="f.v1", workers=3, holder="me")
    for f in (hello, feed.Frame(feed.RECORDS, lines=("a", "é")), feed.Frame(feed.HOLDER), feed.Frame(feed.HOLDER, holder="x"), feed.Frame(feed.COMPLETE), feed.Frame(feed.FAULT, error="no")):
        assert feed.decode(feed.encode(f)) == f
    out = io.BytesIO()
    feed.serve(out, hello, [([], "me"), (["l1"], "me"), ([], None)])
    out.seek(0)
    reader, lines = feed.Follower(), []
    for f in feed.read(out):
        lines += reader.take(f)
        if f.kind == feed.RECORDS and not lines:
            assert reader.complete_history  # an empty history is one too
    assert lines == ["l1"] and reader.over and reader.holder is None and reader.hello == hello
    with pytest.raises(ValueError, match="Hello"):
        feed.Follower().take(feed.Frame(feed.COMPLETE))
    with pytest.raises(ValueError, match="protocol"):
        feed.decode(feed.encode(feed.Frame(feed.HELLO, protocol=9)))
    with pytest.raises(ValueError, match="cut off"):
        list(feed.read(io.BytesIO(out.getvalue()[:-1])))
    assert feed.ended("failed", False, "x") and feed.ended("in_progress", True, None) and not feed.ended("in_progress", True, "x")


def test_ceiling():
    fired = []
    with supervise.ceiling(0.05, lambda: fired.append(1)) as late:
        time.sleep(0.3)
    with supervise.ceiling(30, lambda: fired.append(2)) as early, supervise.ceiling(None, lambda: fired.append(3)):
        pass
    assert fired == [1] and late.fired and not early.fired


def test_reports(spark):
    log = spark.createDataFrame(
        [("s", k, t, e, task, w, a, d, h, n, r) for k, (t, e, task, w, a, d, h, n, r) in enumerate([
            (0, "search_started", None, None, None, None, None, 2, None), (0, "worker_bound", None, 0, None, "gpu", "", None, None), (1000, "leased", "aa", 0, 0, None, None, None, None), (2500, "failed", "aa", None, 0, None, None, None, "boom"),
            (3000, "leased", "aa", 0, 1, None, None, None, None), (4000, "lease_expired", "aa", 0, None, None, None, None, None), (61000, "rejected", "aa", None, 1, None, None, None, "no"), (96000, "queued", "bb", None, None, None, None, None, None)])],
        "search_id string, seq long, ts_ms long, event string, task string, worker long, attempt int, device string, host string, tasks long, reason string",
    )
    attempts, outcomes = journal.task_attempts(log), journal.task_outcomes(log)
    block = render.task_block(attempts, outcomes, spark.createDataFrame([], "task string, record string, stats string"), "aa").split("\n")
    assert block[:2] == ["task     aa", "state    rejected on attempt 1: no"]
    assert block[3].split() == ["attempt", "worker", "host", "device", "outcome", "elapsed"]
    assert block[4].split() == ["0", "w0", "—", "gpu", "failed", "1.5s", "boom"] and block[5].endswith("58.0s    no (lease expired)")
    digest_ = render.failures_block("s" * 20, journal.failed_tasks(log), attempts).split("\n")
    assert digest_[0] == "search ssssssssssss   1 task did not commit" and digest_[3].split() == ["aa", "rejected", "2", "w0", "no"]
    timeline = render.timeline_block(log).split("\n")
    assert timeline[1] == "wall-clock   1m36s" and any("failed attempts / attempts" in x and x.endswith("2 / 2  =  100.0%") for x in timeline)
    assert timeline[-1].startswith("  w0") and "█" in timeline[-1] and len(timeline[-1].split("  ", 2)[2].strip()) <= 48
    assert render.machines_block(spark.createDataFrame([], "provider string, machine string, incidents long, lost long, never_ready long, probe_failed long, install_failed long, blacklisted boolean")) == "no machine incidents recorded"
    closed = spark.createDataFrame([("g1", 0, 90_000, D(3_000_000), D(75_000))], "tag string, started_ms long, ended_ms long, price_micro_usd_hour decimal(20,0), cost_micro_usd decimal(20,0)")
    held = spark.createDataFrame([("g2", D(1_000_000), D(5))], "tag string, rate decimal(20,0), accrued decimal(20,0)")
    assert render.spend_block(closed, held, 75_005).split("\n") == ["closed rentals   1", "  g1  1m30s  $3.000/hr  $0.075", "open rentals     1", "  g2  $1.000/hr  $0.000 so far", "total            $0.075"]
    assert render.summary_lines(spark.createDataFrame([("a", "x=1"), ("b", "x=1"), ("c", "x=0")], "task string, stats string")) == ["3 committed tasks", "2  x=1", "1  x=0"]


FILE = """
[search]
root_seed = 4
format = "stub.v1"
[search.generator]
id = "stub.v1"
count = 3
[config]
max_attempts = 2
checkpoint_interval_steps = 5
[orchestrator]
migrate = "box"
[[orchestrator.device]]
select = "gpu"
workers = 2
[host.box]
workers = 4
[host.cloud]
provider = "vast"
[host.cloud.constraints]
max_price_usd_hour = 0.5
min_vram_mb = 10
[host_class.lab]
ssh = ["a", "b"]
[fleet]
members = ["box", "lab", "cloud"]
[budget]
max_spend_usd = 2.5
"""


def test_the_whole_configuration():
    got = searchfile.load(FILE)
    assert got.fleet == ("box", "lab", "cloud") and got.classes["lab"].addresses == ("a", "b") and got.max_spend_micro == 2_500_000
    assert got.hosts["cloud"].constraints.max_price == 500_000 and got.devices == (searchfile.Device("gpu", 2),) and got.checkpoint_interval_steps == 5


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        ("[config]", "[config]\nnope = 1", "unknown nope"),
        ('id = "stub.v1"', "", "missing id"),
        ("max_attempts = 2", "max_attempts = 0", "at least 1"),
        ('migrate = "box"', 'migrate = "lab"', "no host"),
        ('members = ["box", "lab", "cloud"]', 'members = ["who"]', "no host and no class"),
        ('ssh = ["a", "b"]', 'ssh = ["a", "box"]', "twice"),
        ("[host_class.lab]", "[host_class.box]", "both"),
        ('provider = "vast"', 'provider = "vast"\nssh = "x"', "no address"),
        ("workers = 4", "workers = 4\n[[host.box.device]]\nselect = 'g'\nworkers = 1", "exclude"),
    ],
)
def test_a_wrong_configuration_is_refused(old, new, says):
    with pytest.raises(ValueError, match=says):
        searchfile.load(FILE.replace(old, new, 1))


def test_chains_walk_together(spark):
    starts = spark.createDataFrame([("a", 1), ("b", 3)], "chain string, state int")
    links = spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "state int, next_state int")
    got = sorted((r.chain, r.segment, r.state) for r in store.chain_walk(spark, starts, links, 4).collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 2), ("a", 3, 2), ("b", 0, 3), ("b", 1, 9)]
