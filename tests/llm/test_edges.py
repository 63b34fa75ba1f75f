"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from runlode.llm import ann, decontaminate, html_text, lm, mixing, pii, quality, simhash, toxicity

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ROWS = [(1, "The cat sat on the mat today", "a"), (1, "The cat sat on the mat today", "a"), (2, None, None), (3, "", "b"), (None, "no id here at all", "a"), (4, LONG, "b"), (5, "é ü 漢字 \u0085x", "a"), (6, " \t\n", None), (7, "mail a.b@c.org, +1 (555) 123-4567!", "a")]
#: Columns that the operators might use for themselves.
EXTRA = ["fp", "th", "n", "h", "w", "s", "token", "size", "piece", "spans", "items", "score", "label", "x", "key", "rank", "list", "position", "_text", "_id", "group"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (4, 1, 1), (99, 1, 1), (5, None, None), (5, 7, 7))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "deduplicate": lambda s, d: simhash.deduplicate(d),
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s), F.lit(True))),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s), F.lit(True))),
    "lm": lambda s, d: lm.score(d, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), vocabulary=5, coded=3),
    "decontaminate": lambda s, d: decontaminate.contamination(d, s.createDataFrame([(1, "cat SAT on"), (2, None), (None, "mat"), (3, "")], "item_id long, text string"), length=3),
    "pii": lambda s, d: pii.label(pii.candidates(d), pii.fit(pii.candidates(d))),
    "html": lambda s, d: html_text.extract(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    got = OPERATORS[name](spark, documents(spark))
    if name == "deduplicate":
        assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "4", "5", "7", "None"]
    else:
        assert got.count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["mixing", "simhash", "lm", "quality", "decontaminate", "pii"])
def test_all_texts_empty(spark, name):
    df = documents(spark, [(k, None if k % 2 else "", None) for k in range(6)])
    assert OPERATORS[name](spark, df).count() == 6


def shown(df):
    """Rows as text, doubles to six digits: sums over a batch may differ in their last bits."""
    return sorted(str([float(f"{v:.6g}") if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_reruns_and_partitionings_agree(spark):
    for name in ("mixing", "quality", "toxicity", "lm", "pii"):
        one = shown(OPERATORS[name](spark, documents(spark)))
        two = shown(OPERATORS[name](spark, documents(spark).repartition(3, "source")))
        assert one == two, name


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (50, [0.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("list", F.lit(2))
    got = ann.search(v, v.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 1.0), (0, 2, 0.707107), (0, 2, 0.707107), (0, 50, 0.0), (50, 2, 0.707107), (50, 2, 0.707107), (50, 0, 0.0), (50, 1, 0.0)]
    assert ann.search(v.limit(0), v, k=5).count() == 0
    assert ann.search(v, v.limit(0), k=5).count() == 0
