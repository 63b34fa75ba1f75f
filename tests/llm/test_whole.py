"""The whole job: cases in which an operator once did less."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlode.llm import html_text, lm, mixing, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_are_those_of_brute_force_jaccard(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(30)]
    texts = [[word() for _ in range(rng.randint(3, 120))] + line * (k % 3 == 0) for k in range(120)]
    for base in [*texts[:40], *[texts[0]] * 60]:  # near copies of all degrees, and one large group
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", "  ", "A b", "a B", "a b c"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(root) and len(got) < len(texts) - 30


def test_words_beyond_the_most_frequent_predict_each_other(spark):
    rng = random.Random(5)
    def text():
        pairs = [rng.randrange(600) for _ in range(60)]
        return " ".join(f"a{k} b{k}" for k in pairs)
    docs = spark.createDataFrame([(k, text()) for k in range(140)], "doc_id long, text string")
    r = lm.score(docs, F.col("doc_id") % 7 != 2).where("doc_id % 7 = 2").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.7 * r[1]  # half of all words follow from the one before


def test_every_round_has_its_position(spark):
    rows = [(k, "w " * (k % 5 + 1), "b" if k % 4 == 0 else "a") for k in range(80)]
    rows += [(k, "w " * 3, "c") for k in range(80, 90)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    slope, seen = 0.5, 0
    line = defaultdict(list)
    for r in mixing.in_training_order(mixed).collect():
        line[r.source].append((r.position, r.taken, r.target))
    for placed in line.values():
        built = 0
        for position, taken, target in placed:
            t = position  # the demand built up by then is what has been handed out
            assert math.isclose((1 - slope) * t + slope * t * t, built / target, abs_tol=1e-9)
            built += taken
        assert math.floor(placed[0][2]) - 1 <= built <= placed[0][2]
        seen += len(placed)
    assert all(r.position == (r.positions[0] if r.positions else None) for r in mixed.collect())
    assert seen > len(rows) / 2 and max(len(r.positions) for r in mixed.collect()) == 3


def test_op1_is_in_the_order_of_positions(spark):
    got = [r.position for r in queries.op1_mixing(spark, "/root/testdata/sf0.001").collect() if r.position is not None]
    assert got == sorted(got)


@pytest.mark.parametrize("attrs", ['title="a hidden gem"', 'data-x="is hidden here"', 'class="menu hidden md"', 'data-style="display:none"', "aria-hidden=false"])
def test_quoted_values_hide_nothing(attrs):
    assert html_text.text_of(f"<div {attrs}>seen</div>") == "seen"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<svg><title>no</title><desc>no</desc><text>A</text><text>B</text></svg>", "A\nB"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ('<p hidden="">no</p><p style="color:red; DISPLAY : none !important">no</p><p style=visibility:hidden>no</p>y', "y"),
    ],
)
def test_shown_elements_keep_their_text(page, text):
    assert html_text.text_of(page) == text


@pytest.mark.parametrize(
    ("row", "text"),
    [
        ("note<td>x</td>", "note  x"),
        ("<b>x</b>", "x"),
        ("<form><td>a</td></form>", "a"),
        ("<form><td>a<td>b</form><td>c", "a  b  c"),
        ("<td>a</td>some <b>more</b><td>c", "a  some more  c"),
        ("<i hidden>no</i><td>a", "a"),
    ],
)
def test_rows_keep_what_is_not_in_cells(row, text):
    assert html_text.text_of(f"<table><tr>{row}</tr></table>") == text


def test_near_copies_within_a_common_passage(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(9000)}"
    passage = [word() for _ in range(45)]
    texts = [[word() for _ in range(own)] + passage for own in (rng.choice([2, 6, 40, 90]) for _ in range(70))]
    for base in texts[:50]:
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy[: len(copy) - rng.choice([0, 0, 4, 12])])
    texts = [" ".join(t) for t in texts]
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(root) and 20 < len(got) < len(texts) - 20
