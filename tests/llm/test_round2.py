"""Cases that the second round of findings named."""

from __future__ import annotations

import ctypes
import math
import os
import random
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa

import corpus_pipeline
from runlode.llm import common, lm, nearcopies, quality, simhash
from tests.llm.test_operators import small_model


# ---- language model


def test_long_texts_are_scored_by_the_same_steps_as_short_ones():
    m = small_model()
    n, length = m.coded + 1 + lm.CLASSES, m.code[0]
    context, total = [], 0
    while total + length[2] <= 512:  # some of the symbols that may come next end beyond 512 steps, some before
        context.append(len(context) % 4)
        total += length[context[-1]]
    before = lm.mix(m, lm.bits(m, [np.array(context)]), block=1)[0][0]
    after = lm.mix(m, lm.bits(m, [np.array([*context, s]) for s in range(n)]), block=1)[0]
    assert math.isclose(sum(10 ** (after - before)), 1, abs_tol=2e-3)


def test_counts_are_those_of_all_decisions():
    m = small_model()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, m.coded + 1 + lm.CLASSES, 50) % rng.integers(2, 300) for _ in range(40)] + [np.array([6])]
    got = np.zeros(2 * m.cells, np.uint32)
    lm.tally(m, docs, got)
    x = lm.bits(m, docs)
    want = sum(np.bincount(x[c] * 2 + x["bit"], minlength=len(got)) for c in ("h1", "h2", "match"))
    assert np.array_equal(got, want)


def test_words_by_columns_are_those_of_each_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\x0b\r\n\x1c\x85\xa0aAbZé中\x00İ") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " "]
    own = [(t or "").encode().lower().split() for t in texts]
    ids = {w: k for k, w in enumerate(sorted({w for o in own for w in o})[::3])}
    m = lm.Model(ids, 20, np.array([*map(lm.escape_class, ids), 0]), np.zeros(len(ids) + 1), np.zeros(lm.CLASSES), lm.huffman([1.0] * (21 + lm.CLASSES)), np.zeros(0))
    c = lm.coding(m, pa.array(["left out", *texts])[1:])
    assert [d.tolist() for d in c.docs] == [[*(k if (k := ids.get(w, 20)) < 20 else 21 + lm.escape_class(w) for w in o), 20] for o in own]
    assert c.rare.to_pylist() == [w for o in own for w in o if w not in ids]


# ---- near copies


def test_near_copies_come_from_simhash_and_are_checked(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    long_ = [word() for _ in range(400)]
    texts = [" ".join(long_), " ".join([*long_[:-1], "other"])]  # a near copy within two bits
    texts += ["a b c " * 60 + " ".join(word() for _ in range(9)) for _ in range(2)]  # one fingerprint, but not alike
    texts += [" ".join(word() for _ in range(50)) for _ in range(4)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.doc_id: r.group for r in simhash.near_duplicates(docs).collect()}
    assert groups[0] == groups[1] and groups[2] == groups[3] and len(set(groups.values())) == 6
    linked, given = nearcopies.fingerprinted, []
    monkeypatch.setattr(nearcopies, "fingerprinted", lambda *a: given.append(linked(*a).count()) or linked(*a))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {0, *range(2, 8)} and given == [1]


# ---- the driver's memory


def test_free_memory_goes_back_to_the_system(spark):
    c = ctypes.CDLL(None)
    c.malloc.restype, c.malloc.argtypes, c.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    held = [c.malloc(100_000) for _ in range(2000)]  # too small for mappings of their own
    for p in held:
        ctypes.memset(p, 1, 100_000)
    for p in held[:-1]:  # the last one keeps the others from going by themselves
        c.free(p)
    own = psutil.Process(os.getpid())
    before = own.memory_info().rss
    common.sweep(spark)
    after = own.memory_info().rss
    c.free(held[-1])
    assert before - after > 100_000_000


def test_terms_are_held_once_while_their_space_is_sought(monkeypatch):
    seen, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: seen.append(tracemalloc.get_traced_memory()[0]) or eigh(a))
    tracemalloc.start()
    try:
        x = np.random.default_rng(1).random((3000, quality.TERMS), np.float32)
        quality.train(x, np.arange(3000) % 2.0)
    finally:
        tracemalloc.stop()
    assert seen[0] < x.nbytes + 8 * quality.TERMS**2 + 8_000_000
