"""Cases in which an operator once gave a wrong result or cut its work."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlode.llm import ann, chat, common, html_text, nearcopies, pii, quality, simhash, toxicity


def test_a_streamed_log_folds_back_to_its_rows(spark):
    rows = [(1, t, r, x) for t, r, x in ((0, "user", "hello"), (1, "assistant", None), (1, "assistant", "é<|im_end|>"), (2, "user", "odd"), (None, None, "a"), (2, "user", "odd"))] + [(None, 0, "user", "x"), (7, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("op", F.lit("delete"))
    plain = {r.conv_id: r.formatted for r in chat.render(df).collect()}
    folded = {r.conv_id: r.formatted for r in chat.render(chat.fold(chat.as_log(df))).collect()}
    assert plain == folded and len(plain) == 3
    assert chat.fold(chat.as_log(df.limit(0))).count() == 0
    ops = {r.op for r in chat.as_log(df).select("op").distinct().collect()}
    assert ops == {"message", "delta", "edit", "regenerate"}


@pytest.mark.parametrize("dedup", [simhash.deduplicate, nearcopies.deduplicate])
def test_columns_of_any_name_come_back(spark, dedup):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (None, "x", 1, 2, 3), (3, "x", 4, 5, 6)], "doc_id long, text string, _k long, _h long, _n long")
    got = sorted(map(tuple, dedup(df).collect()))
    assert got == [(1, "a b c d e f", 7, 8, 9), (3, "x", 4, 5, 6)]  # a null id comes after all others


def test_contradicting_labels_take_no_part(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, quality.agreed(labels, F.lit(True), "doc_id", "quality").collect())) == [(2, 1), (3, 0)]
    docs = spark.createDataFrame([(2, f"good text number {k % 9}") for k in range(3000)] + [(3, "bad"), (1, "both")], "doc_id long, text string")
    model = quality.fit(docs, labels, F.lit(True), per_class=5)
    assert (model.labels == 1).sum() == 5 and (model.labels == 0).sum() == 1
    assert toxicity.fit(docs, labels, F.lit(True), toxic_docs=4).prior == 0.5


def test_offsets_hold_where_lower_case_is_longer():
    text = "İstanbul is a bad day here"
    model = toxicity.Model({"": -8.0, "wbad": 20.0}, np.zeros((2, 2)), 0.0, 0.5)
    p = model.marginals([toxicity.tokens(text)])[0]
    (span,) = toxicity.spans_of(text, p, 0.5)
    assert text[span["start"] : span["end"]] == "bad"
    assert toxicity.train([(["a", "b"], True)]).marginals([["c"]])[0][0] > 0.9


def test_vectors_of_any_size_and_ids_of_any_value(spark):
    big = 9007199254740993
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 1e-200]), (big, [1.0, 0.0]), (None, [0.0, 2.0]), (50, [1.0, 2.0, 3.0]), (51, [2.0, 4.0, 6.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in ann.search(v, v.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()]
    half = round(math.sqrt(0.5), 9)
    assert sorted(got[:2]) == [(0, 1, 1.0), (0, 2, 1.0)] and sorted(map(str, got[2:4])) == sorted(map(str, [(0, big, half), (0, None, half)])) and got[4:] == [(50, 51, 1.0)]


def test_the_final_classifier_goes_by_shape_alone():
    key, path = "secret*|n6|d2|tight|hex|quote|quote|token", "secret*|n5|d0|joined|letters|space|space|"
    _, shapes = pii.estimate([((1, 0, 1, -1), key, 160), ((-1, 0, 0, 1), path, 40)])
    score = lambda shape: shapes[None] + sum(shapes.get((j, x), 0.0) for j, x in enumerate(shape.split("|")))
    assert score(key) > 2 and score(path) < -2


def test_keys_and_tokens_are_candidates(spark):
    texts = ['say token = "0123456789abcdef0123456789abcdef01234567" end', "plain words only", None, "averyveryverylongwordwithoutdigits", "12345678901234567890123"]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: [(x.kind, x.start, x.end, x.base) for x in r.spans] for r in found.collect()} == {0: [("secret", 13, 53, False)], 1: [], 2: [], 3: [], 4: []}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<pre><span>a</span>  <span>b</span></pre>", "a  b"),
        ("<pre><div>a  b\n c</div></pre>", "a  b\n c"),
        ("<table><tr><td rowspan=2>a<td>bb<td>c<tr><td>d<td>e</table>", "a  bb  c\n   d   e"),
        ("<table><tr><td colspan=500>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<ol data-start=7><li>x</ol>", "1. x"),
        ("<a href='x>y'>z</a>", "z"),
    ],
)
def test_layout(page, text):
    assert html_text.text_of(page) == text


def test_broken_and_deep_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<a " * 40_000, '<a x="' * 20_000, "<div>" * 20_000 + "x", "<table><tr>" + "<form>" * 5000 + "<td>q"):
        html_text.text_of(page)
    assert time.time() - began < 20
    assert html_text.text_of("<div>" * 1000 + "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "- a\n- b\n\nc  d"


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_a_large_group_that_does_not_connect(spark, monkeypatch):
    """Texts that differ from one base each in its own way: bitmaps leave out no near copy and few others leave the join."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(160):
        words = list(base)
        for place in rng.sample(range(len(words)), 2 + k % 6):
            words[place] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bitmaps, used = nearcopies._bitmaps, []
    monkeypatch.setattr(nearcopies, "_bitmaps", lambda *given: used.append(1) or bitmaps(*given))
    kept = {r.doc_id for r in nearcopies.deduplicate(docs).select("doc_id").collect()}
    assert used
    assert kept == {a for a in range(len(texts)) if root[a] == a}
    assert 1 < len(kept) < len(texts)
