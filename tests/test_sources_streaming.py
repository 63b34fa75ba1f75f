import json

import pytest

from runlode.operators import journal as ops
from runlode.sources import config, ledgers
from runlode.sources import journal as src
from runlode.streaming import collector, status

LINES = [
    {"ts_ms": 1, "event": "search_started", "search": "s", "tasks": 2, "committed": 0},
    {"ts_ms": 2, "event": "worker_bound", "worker": 0, "device": "d", "driver": "1", "host": ""},
    {"ts_ms": 3, "event": "leased", "task": "aa", "worker": 0, "attempt": 0},
    {"ts_ms": 4, "event": "committed", "task": "aa", "record": "r", "stats": [{"name": "x", "value": None}], "stats_blob_hex": ""},
]


def write(path, lines=LINES, tail=""):
    src.append_lines(str(path), [json.dumps(x) for x in lines])
    with open(path, "a") as f:
        f.write(tail)


def test_read_journal_leaves_the_torn_tail(spark, tmp_path):
    write(tmp_path / "s1.jsonl", tail='{"ts_ms": 5')
    j = src.read_journal(spark, str(tmp_path / "*.jsonl"))
    rows = j.orderBy("seq").collect()
    assert [(r.search_id, r.seq, r.event) for r in rows] == [("s1", k, x["event"]) for k, x in enumerate(LINES)]
    assert rows[3].stats[0].value != rows[3].stats[0].value  # null is not a number
    assert ops.status_counts(j).first().committed == 1
    offsets = [r.offset for r in src.read_lines(spark, str(tmp_path / "*.jsonl")).orderBy("seq").collect()]
    assert offsets[1] == len(json.dumps(LINES[0])) + 1


def test_missing_journal_is_empty_and_bad_lines(spark, tmp_path):
    assert src.read_journal(spark, str(tmp_path / "none.jsonl")).count() == 0
    write(tmp_path / "s.jsonl", tail="not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_journal(spark, str(tmp_path / "s.jsonl")).collect()
    assert src.read_journal(spark, str(tmp_path / "s.jsonl"), strict=False).count() == 4


@pytest.mark.parametrize("line", ["", "a\nb", "a\r"])
def test_append_refuses(tmp_path, line):
    with pytest.raises(ValueError, match="line"):
        src.append_lines(str(tmp_path / "x"), ["ok", line])
    assert not (tmp_path / "x").exists()


def test_data_source_and_offsets(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    write(path, tail="part")
    spark.dataSource.register(src.JournalSource)
    assert spark.read.format("runlode_journal").option("path", str(path)).load().count() == 4
    data, end = src.complete_region(str(path), 0)
    assert data.endswith(b"\n") and src.complete_region(str(path), end) == (b"", end)


def test_stream_is_the_batch(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    write(path, LINES[:2])
    query = status.follow_statuses(src.follow(spark, str(path))).writeStream.format("memory").queryName("followed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        write(path, LINES[2:])
        query.processAllAvailable()
        rows = spark.sql("select * from followed order by seq").collect()
    finally:
        query.stop()
    batch = status.fold_statuses(src.read_journal(spark, str(path))).first()
    assert rows[-1] == batch and json.loads(batch.devices) == {"d": 1} and batch.tasks == 2


def test_collector_writes_what_follow_reads(spark, tmp_path):
    schema = "search_id string, ord long, event string"
    rows = [("s", k, json.dumps({a: b for a, b in x.items() if a != "ts_ms"})) for k, x in enumerate(LINES)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    (tmp_path / "out").mkdir()
    query = collector.collect(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", now_ms=lambda: 5, availableNow=True)
    assert query.awaitTermination(60)
    got = src.read_journal(spark, f"{tmp_path}/out/s.jsonl").orderBy("seq").collect()
    assert [(r.event, r.ts_ms) for r in got] == [(x["event"], 5) for x in LINES]


def test_fold_ignores_what_it_has_seen():
    f = status.Fold()
    f.apply(0, "committed", "a", None, None, None, None)
    again = status.Fold(f.saved())
    again.apply(0, "committed", "a", None, None, None, None)
    assert again.d["committed"] == 1


def test_two_workers_on_one_task():
    f = status.Fold()
    for k, e in enumerate([("worker_bound", None, 1, "A", ""), ("worker_bound", None, 2, "B", ""), ("leased", "t", 2, None, None), ("leased", "t", 1, None, None), ("committed", "t", None, None, None), ("committed", "t", None, None, None)]):
        f.apply(k, *e, None)
    assert f.d["devices"] == {"A": 1, "B": 1} and f.d["held"] == {}


def test_rate_limit_counts_from_the_last_told(spark):
    rows = [("a", k, t) for k, t in enumerate((0, 6, 10, 15, 19, 20))]
    got = status.limited(spark.createDataFrame(rows, "k string, seq long, ts_ms long"), ["k"], 10).orderBy("seq").collect()
    assert [r.ts_ms for r in got] == [0, 10, 20]


def test_saves(spark):
    rows = [("a", k, t, 0) for k, t in enumerate((1, 2, 3, 50, 51, 52))]
    df = spark.createDataFrame(rows, "k string, seq long, ts_ms long, start_ms long")
    assert [r.seq for r in status.saves(df, ["k"], 2, None).orderBy("seq").collect()] == [1, 3, 5]
    assert [r.seq for r in status.saves(df, ["k"], None, 40).orderBy("seq").collect()] == [3]
    assert [r.seq for r in status.saves(df, ["k"], 3, 40).orderBy("seq").collect()] == [2, 3]


def test_ledger_files_are_named_for_their_rows(spark, tmp_path):
    row = {"provider": "p", "machine": "m", "kind": "lost", "tag": "t1", "occurred_ms": 5}
    (tmp_path / "t1.json").write_text(json.dumps(row, indent=1))
    assert ledgers.read_ledger(spark, str(tmp_path), ledgers.INCIDENTS, "tag").count() == 1
    (tmp_path / "t2.json").write_text(json.dumps(row))
    with pytest.raises(Exception, match="named"):
        ledgers.read_ledger(spark, str(tmp_path), ledgers.INCIDENTS, "tag").collect()


def test_offers_are_pushed_and_normalised(spark, tmp_path):
    rows = [{"id": 1, "machine_id": 2, "gpu_name": "X", "num_gpus": 2, "gpu_ram": 8, "cuda_max_good": None, "dph_total": 0.0824, "reliability": 0.9, "verification": "verified"}, {"id": 2, "dph_total": None}, {"id": 3, "dph_total": 1.0, "num_gpus": 1}]
    (tmp_path / "o").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = {r.id: r for r in ledgers.read_offers(spark, str(tmp_path / "o")).collect()}
    assert set(got) == {"1", "3"} and got["1"].price == 82_400 and got["1"].cuda == 0.0 and got["3"].machine == ""
    assert [r.id for r in ledgers.read_offers(spark, str(tmp_path / "o")).where("gpu_count >= 2").collect()] == ["1"]
    assert ledgers.query_price(82_401) == 0.09


def test_devices(spark):
    lines = spark.createDataFrame([('{"class":"a","name":"n","device_type":"cpu","idx":0}',), ("  ",)], "value string")
    assert ledgers.parse_devices(lines).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        ledgers.parse_devices(spark.createDataFrame([("x",)], "value string")).collect()


def test_payload_and_pack(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "b").write_bytes(b"1")
    (tmp_path / "in" / "d" / "a").write_bytes(b"2")
    files = ledgers.ingest(spark, str(tmp_path / "in"))
    assert [r.path for r in files.collect()] == ["b", "d/a"]
    ledgers.write_pack(files.select("hash", "bytes"), str(tmp_path / "pack"), 2)
    assert ledgers.read_pack(spark, str(tmp_path / "pack")).count() == 2
    key = files.first().hash
    assert ledgers.get_object(spark, str(tmp_path / "pack"), key) == b"1" and ledgers.get_object(spark, str(tmp_path / "pack"), "0") is None


def test_config():
    text = '[search]\nroot_seed = 1\nformat = "f.v1"\ngenerator = "g"\n[[fleet]]\ndestination = "h"\n'
    assert config.load(text).fleet[0].count == 1
    for bad, said in ((text + 'extra = 1\n', "unknown"), (text.replace("root_seed = 1\n", ""), "missing"), (text + '[[fleet]]\ndestination = "h"\n', "twice"), (text.replace('"f.v1"', '"F"'), "name"), (text.replace("generator = ", 'segments = 2\nparams = {snapshot_when = {scalar = "a", min = 1}}\ngenerator = '), "unsegmented")):
        with pytest.raises(ValueError, match=said):
            config.load(bad)
