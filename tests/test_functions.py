import numpy as np
import pytest
from pyspark.sql import functions as F

from runlode.functions import codec
from runlode.functions import scalars as fn
from runlode.functions.blake3 import blake3, blake3_many
from runlode.operators import generate, simulate

#: Published words of the counter stream, fixed.
WORDS = {0: ["E220A8397B1DCDAF", "6E789E6AA1B965F4", "06C45D188009454F", "F88BB8A8724C81EC"], 1: ["910A2DEC89025CC1", "BEEB8DA1658EEC67", "F893A2EEFB32555E", "71C18690EE42C90B"]}
DERIVED = {(0, 0): "0000000000000000", (0, 1): "7AB40E090F363A7D", (0, 2): "52EAD7E36EA7FEA8", (1, 1): "83EC686C1600460A"}
#: Published digests, fixed; inputs are bytes 0, 1, ... 250 over and over.
DIGESTS = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}


def test_stream_words(spark):
    for seed, words in WORDS.items():
        got = spark.range(4).select(fn.hex64(fn.draw(F.lit(seed).cast("long"), F.col("id"))).alias("w")).collect()
        assert [r.w for r in got] == words
        assert [f"{fn.draw_int(seed, k):016X}" for k in range(4)] == words
    for (seed, tag), word in DERIVED.items():
        assert spark.range(1).select(fn.hex64(fn.derive(F.lit(seed).cast("long"), F.lit(tag)))).first()[0] == word
        assert f"{fn.derive_int(seed, tag):016X}" == word


def test_stream_on_random_words(spark):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 50)]
    rows = spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "s long, k long").select("s", "k", fn.draw(F.col("s"), F.col("k")).alias("w"), fn.derive(F.col("s"), F.col("k")).alias("d")).collect()
    m = (1 << 64) - 1
    assert all(r.w & m == fn.draw_int(r.s & m, r.k) and r.d & m == fn.derive_int(r.s & m, r.k) for r in rows)


def test_unit(spark):
    got = spark.createDataFrame([(0,), (-1,), (0xE220A8397B1DCDAF - (1 << 64),)], "x long").select(fn.unit_f64(F.col("x")).alias("u")).collect()
    assert [np.float64(r.u).view(np.uint64) for r in got] == [0, 0x3FEFFFFFFFFFFFFF, 0x3FEC4415072F63B9]


def test_blake3(spark):
    data = {n: bytes(k % 251 for k in range(n)) for n in DIGESTS}
    assert [x.hex() for x in blake3_many(list(data.values()))] == list(DIGESTS.values())
    sizes = [0, 63, 64, 65, 1023, 2048, 3072, 3073, 5000, 7 * 1024 + 1]
    many = blake3_many([bytes(k % 251 for k in range(n)) for n in sizes])
    assert many == [blake3_many([bytes(k % 251 for k in range(n))])[0] for n in sizes]
    rows = spark.createDataFrame([(b"",), (None,)], "b binary").select(blake3("b").alias("h")).collect()
    assert rows[0].h.hex() == DIGESTS[0] and rows[1].h is None


def test_codec():
    e = codec.Encoder().u8(1).flag(True).u16(2).u32(3).u64(1 << 63).i64(-5).f32(0.5).f64(-0.0).data(b"xy").text("é").maybe_u64(None).maybe_u64(7).maybe_digest(None).f32s([1, 2])
    d = codec.Decoder(e.done())
    assert (d.u8(), d.flag(), d.u16(), d.u32(), d.u64(), d.i64(), d.f32(), str(d.f64()), d.data(), d.text(), d.maybe_u64(), d.maybe_u64(), d.maybe_digest(), d.f32s(2)) == (1, True, 2, 3, 1 << 63, -5, 0.5, "-0.0", b"xy", "é", None, 7, None, (1.0, 2.0))
    d.end()
    with pytest.raises(ValueError, match="early"):
        codec.Decoder(b"\x01").u16()
    with pytest.raises(ValueError, match="flag"):
        codec.Decoder(b"\x02").flag()
    with pytest.raises(ValueError, match="segments"):
        codec.search_bytes(1, 0, "f", "g", b"", b"")


def test_continuation():
    grid = codec.grid_bytes(2, 1, 2, [1.0, 2.0, 3.0, 0.5])
    assert codec.continuation_from(codec.continuation_bytes(7, grid)) == (7, (2, 1, 2, (1.0, 2.0, 3.0, 0.5)))
    for bad in (grid[:-1], grid + b"x", b""):
        with pytest.raises(ValueError):
            codec.grid_from(bad)


def test_identities_depend_on_every_part():
    h = [bytes([k]) * 32 for k in range(4)]
    base = codec.TaskIdentity(h[0], h[1], 5, h[2])
    others = [codec.TaskIdentity(h[3], h[1], 5, h[2]), codec.TaskIdentity(h[0], h[3], 5, h[2]), codec.TaskIdentity(h[0], h[1], 6, h[2]), codec.TaskIdentity(h[0], h[1], 5, h[3]), codec.TaskIdentity(h[0], h[1], 5, h[2], h[3])]
    assert len({base.key(), *[x.key() for x in others]}) == 6
    assert codec.environment_bytes([("b", "1", h[0]), ("a", "1", h[1])]) == codec.environment_bytes([("a", "1", h[1]), ("b", "1", h[0])])


def test_formats(spark):
    row = spark.range(1).select(
        fn.render_stats(F.expr("array(named_struct('name','population','value',0.5D),named_struct('name','activity','value',1e-4D))"), F.lit("aabbcc")).alias("a"),
        fn.number(F.lit(5.0)).alias("b"),
        fn.number(F.lit(float("nan"))).alias("c"),
        fn.dollars(F.lit(1_234_567).cast("decimal(20,0)")).alias("d"),
        fn.percent(F.lit(1), F.lit(0)).alias("e"),
        fn.duration(F.lit(3_725_000).cast("long")).alias("f"),
        fn.per_task(F.lit(3), F.lit(2)).alias("g"),
        fn.number(F.lit(0.0)).alias("h"),
    ).first()
    assert tuple(row) == ("population=0.5 activity=0.0001 blob=3B", "5", "NaN", "$1.235", "—", "62m05s", "1.50 per task", "0")


def test_rules(spark):
    row = spark.range(1).select(fn.valid_name(F.lit("a.b-c_9")), fn.valid_name(F.lit("A")), fn.valid_tag(F.lit("a-1")), fn.valid_tag(F.lit("a_1")), fn.valid_owner(F.lit("aF" * 32)), fn.valid_owner(F.lit("a" * 63)), fn.hex_decode(F.lit("AB")), fn.hex_decode(F.lit("ab")), fn.at_least(F.lit(float("nan")), F.lit(0.0)), fn.finite_sign_positive(F.lit(-0.0)), fn.finite_sign_positive(F.lit(0.0)), fn.finite_sign_positive(F.lit(2.5)), fn.finite_sign_positive(F.lit(float("inf")))).first()
    assert tuple(row) == (True, False, True, False, True, False, None, bytearray(b"\xab"), False, False, True, True, False)


def test_reduction(spark):
    def reduced(current, previous, channels, alive, least):
        rows = spark.createDataFrame([(1, current, previous)], "cand int, current array<float>, previous array<float>")
        return {s.name: s.value for s in simulate.grid_reduce(rows, channels, alive, least).first().stats}

    got = reduced([1.0, 2.0, 3.0, 4.0], [0.0] * 4, 1, 0, 3.0)
    assert got == {"c0.mean": 2.5, "c0.var": 1.25, "c0.min": 1, "c0.max": 4, "population": 0.5, "activity": 2.5}
    got = reduced([1.0, 2.0, 3.0, 4.0], [0.0] * 4, 2, 1, 3.0)
    assert got == {"c0.mean": 2, "c0.var": 1, "c0.min": 1, "c0.max": 3, "c1.mean": 3, "c1.var": 1, "c1.min": 2, "c1.max": 4, "population": 0.5, "activity": 2.5}
    assert reduced([4.0, 1.0, 3.0, 2.0], [1.0, 3.0, 3.0, 6.0], 1, 0, 0.0)["activity"] == 2.25
    with pytest.raises(ValueError, match="range"):
        reduced([1.0], [1.0], 1, 1, 0.0)


def test_snapshot(spark):
    rows = spark.createDataFrame([(1, [("a", 1.0)]), (2, [("a", 2.0), ("b", float("nan"))]), (3, [("a", 0.5)])], "cand int, stats array<struct<name:string,value:double>>")
    assert [r.keep for r in simulate.keep_snapshot(rows, "a", 1.0).orderBy("cand").collect()] == [True, False, False]
    assert all(r.keep for r in simulate.keep_snapshot(rows, None, None).collect())


def test_cellular_rules():
    g = np.zeros((4, 4, 1), np.float32)
    g[0, 0] = 1
    assert simulate.smoke_max(g).sum() == 5
    u = np.zeros((4, 4, 2), np.float32)
    u[..., 0] = 1
    assert np.array_equal(simulate.reaction_step(u, 0.05, 0.06, 0.16, 0.08, 1.0), u)  # nothing to react
    assert np.array_equal(simulate.network_step(np.ones((4, 4, 8), np.float32), np.zeros(1091, np.float32), 1.0, 7, 0), np.ones((4, 4, 8), np.float32))


def test_network_step_is_the_plain_loop():
    rng = np.random.default_rng(5)
    w = rng.uniform(-0.5, 0.5, 1091).astype(np.float32)
    g = rng.uniform(0, 1, (3, 4, 8)).astype(np.float32)
    seed, step = 99, 3
    got = simulate.network_step(g, w, 0.5, seed, step)
    perc, w1, b1, w2, b2 = w[:27].reshape(3, 9), w[27:795].reshape(24, 32), w[795:827], w[827:1083].reshape(32, 8), w[1083:]
    for y in range(3):
        for x in range(4):
            seen = [sum(perc[p, dy * 3 + dx] * g[(y + dy - 1) % 3, (x + dx - 1) % 4, c] for dy in range(3) for dx in range(3)) for c in range(8) for p in range(3)]
            hidden = np.maximum(np.array(seen) @ w1 + b1, 0)
            fires = fn.draw_int(fn.derive_int(fn.derive_int(seed, y * 4 + x), 1), step) >> 63 == 0
            assert np.allclose(got[y, x], g[y, x] + fires * 0.5 * (hidden @ w2 + b2), atol=1e-5)


def test_generation_is_the_same_however_dealt(spark):
    rows = generate.candidates(spark, 42, 100)
    ranges = {"feed": (0.01, 0.11)}
    a = generate.reaction_genomes(rows, ranges).orderBy("i").collect()
    b = generate.reaction_genomes(rows.repartition(7), ranges).orderBy("i").collect()
    assert a == b
    assert generate.duplicate_genomes(generate.reaction_genomes(rows, ranges), ["feed"]).count() == 0
    twice = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (4, 2.0)], "i int, feed double")
    assert [tuple(r) for r in generate.duplicate_genomes(twice, ["feed"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="count"):
        generate.candidates(spark, 1, 0)
    w = generate.network_genomes(rows.limit(1), 0.5).first().weights
    assert len(w) == 1091 and max(map(abs, w)) <= 0.5


def test_outcomes(spark):
    rows = [(1, 5, "flaky", 2), (2, 5, "flaky", 3), (3, 5, "reject", 0), (4, 5, "accumulate", 2), (5, 5, "succeed", 0)]
    got = {r.i: (r.attempts, r.outcome) for r in generate.stub_outcomes(spark.createDataFrame(rows, "i int, seed long, behaviour string, n long")).collect()}
    assert got == {1: (3, "committed"), 2: (3, "search_failed"), 3: (1, "rejected"), 4: (1, "committed"), 5: (1, "committed")}
