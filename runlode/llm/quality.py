"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.llm.common import sweep, trim

#: Terms: hashed pairs of bytes, hashed triples of character classes, and bins of repetition.
PAIRS, TRIPLES, BINS = 1024, 1024, 8
TERMS = PAIRS + TRIPLES + 3 * BINS


def _classes() -> np.ndarray:
    """Class of each byte: a lower-case, an upper-case, a digit, a non-ASCII byte, or its own."""
    out = np.arange(256, dtype=np.int64)
    for first, last in ((0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x80, 0xFF)):
        out[first : last + 1] = first
    return out


_CLASS = _classes()
_PAIR = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B1) % np.uint64(1 << 32) >> np.uint64(22)).astype(np.int64)


def _bin(x: float) -> int:
    return min(BINS - 1, int(x * BINS))


def terms(text: str | None) -> np.ndarray:
    """Frequencies of the text's terms; null and wordless texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, dtype=np.float32)
    w = raw.split()
    if not w:
        return out
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) > 1:
        low = np.frombuffer(raw.lower(), dtype=np.uint8).astype(np.int64)
        out[:PAIRS] = np.bincount(_PAIR[low[:-1] << 8 | low[1:]], minlength=PAIRS)
    if len(b) > 2:
        c = _CLASS[b]
        mixed = (c[:-2] * 0x2545F + c[1:-1] * 0x1B873 + c[2:] * 0x85EB) * 0x9E3779B1 >> 12 & TRIPLES - 1
        out[PAIRS : PAIRS + TRIPLES] = np.bincount(mixed, minlength=TRIPLES)
    for part in (out[:PAIRS], out[PAIRS : PAIRS + TRIPLES]):
        np.sqrt(part, out=part)
        part /= max(1e-9, float(np.sqrt(part @ part)))
    lines = [x for x in raw.split(b"\n") if x]
    same = sum(map(eq, w, w[1:])) / max(1, len(w) - 1)
    again = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0
    for k, x in enumerate((same, again, sum(map(bytes.isupper, w)) / len(w))):
        out[PAIRS + TRIPLES + k * BINS + _bin(x)] = 1.0
    return out


@dataclass
class Model:
    """Inverse-document-frequency weights, the projection to the latent space, and the labelled vectors."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.idf) @ self.basis
        n = np.linalg.norm(y, axis=1, keepdims=True)
        return np.divide(y, n, out=np.zeros_like(y), where=n > 1e-6)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its similarity.

        The weight is exp(20 (cosine - 1)), so far neighbours hardly count beside near ones. Texts
        without words, and all texts if nothing is labelled, get the prior.
        """
        if not len(self.labels):
            return np.full(len(x), self.prior)
        y = self.embed(x)
        k = min(self.neighbours, len(self.labels))
        cosines = y @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.exp(20.0 * (np.take_along_axis(cosines, near, axis=1).astype(np.float64) - 1.0))
        votes = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(np.abs(y).sum(axis=1) > 0, votes, self.prior)


def train(x: np.ndarray, labels: np.ndarray, rank: int = 32, neighbours: int = 15, prior: float = 0.5) -> Model:
    """The latent space is spanned by the first ``rank`` eigenvectors of the weighted term covariance."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), labels, neighbours, prior)
    seen = (x > 0).sum(axis=0)
    idf = (0.2 + np.log((1 + len(x)) / (1.0 + seen))).astype(np.float32)
    idf[PAIRS + TRIPLES :] = 1.0
    y = x * idf
    y = (y.T @ y).astype(np.float64)
    _, vectors = np.linalg.eigh(y)
    model = Model(idf, vectors[:, ::-1][:, :rank].astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float64), neighbours, prior)
    model.vectors = model.embed(x).astype(np.float32)
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [terms(t).tobytes() for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], names=["label", "o", "h", "x"])


def agreed(labels: DataFrame, usable: Column, id_col: str, label_col: str) -> DataFrame:
    """(_id, label): the usable ids that have one label, 0 or 1, however often."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull()).where(usable)
    return rows.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, rank: int = 32, neighbours: int = 15) -> Model:
    """A model of at most ``per_class`` labelled documents of each class, the bound of what is broadcast.

    usable: a condition on id_col in labels; other labels are not looked at. The documents are those
    with the least digests of their ids, then of their texts, so the choice does not depend on the
    partitioning; of rows that repeat one is learned from. Labels that are null or neither 0 nor 1
    take no part, nor do ids with both labels. The prior is the share of label 1 among all usable
    ids, 0.5 if there is none.
    """
    usable_rows = agreed(labels, usable, id_col, label_col)
    ones, n = usable_rows.agg(F.sum("label"), F.count("*")).first()
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    chosen = [r for y in (0, 1) for r in usable_rows.where(F.col("label") == y).orderBy(order, "_id").limit(per_class).collect()]
    if not chosen:
        return train(np.zeros((0, TERMS), np.float32), np.zeros(0), rank, neighbours)
    picked = docs.sparkSession.createDataFrame(chosen, usable_rows.schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    found = texts.select("label", order.alias("o"), F.xxhash64("_text").alias("h"), "_text").mapInArrow(_featurize, "label int, o string, h long, x binary")
    # An id may have any number of rows: they are made one a text, and then cut to the bound.
    single = found.groupBy("label", "o", "h").agg(F.min("x").alias("x"))
    first = Window.partitionBy("label").orderBy("o", "h")
    got = single.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_class).select("label", "x").toArrow()
    # The driver holds the terms once: they are put in order into one array, and what they came in goes.
    y = got.column("label").to_numpy().astype(np.float64)
    rows = [np.frombuffer(v.as_buffer(), dtype=np.float32) for v in got.column("x")]
    order_ = np.lexsort((*np.array([v[::97] for v in rows]).reshape(len(rows), len(range(0, TERMS, 97))).T, y))
    x = np.empty((len(rows), TERMS), np.float32)
    for k, i in enumerate(order_):
        x[k] = rows[i]
    got = rows = None
    sweep(docs.sparkSession)
    model = train(x, y[order_], rank, neighbours, ones / n)
    x = None
    trim(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """``keep`` columns, then doc_id and score, for each row of docs; texts are read whole.

    Cosines are computed for ``block`` documents at a time against all labelled vectors.
    """
    rows = docs.select(*[F.col(c) for c in keep if c not in ("doc_id",)], F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = rows.drop("_text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = [model.score(np.stack([terms(t) for t in texts[i : i + block].to_pylist()])) for i in range(0, len(texts), block)]
            found = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)
