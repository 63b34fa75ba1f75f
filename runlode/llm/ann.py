"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are scaled to length 1 and rotated by a fixed orthogonal matrix, so any block of their
components says about as much of a distance as another. Each belongs to the list of its nearest
centroid. A query probes some lists; within a list, partial squared distances grow block of columns
by block of columns, and after each block a candidate whose partial distance, taken for the whole
distance, is significantly above the query's k-th best so far is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    dims: int
    probes: int  #: lists that a query looks into


def fit(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12, k: int = 5, recall: float = 0.97, asked: int = 300) -> Index:
    """Centroids by spherical k-means of unit vectors, the rotation, and how many lists to probe.

    The last is measured: for ``asked`` vectors of the sample, the least number of nearest lists that
    hold the share ``recall`` of their exact ``k`` nearest in the sample. In all vectors, where the
    nearest are nearer, they lie in nearer lists.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = np.unique(sample, axis=0)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), c)
    q = rng.permutation(len(x))[:asked]
    probes = len(c)
    if len(x) > k + 1 and len(c) > 1:
        close = x[q] @ x.T
        close[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
        own = np.argmax(x @ c.T, axis=1)
        place = np.argsort(np.argsort(-(x[q] @ c.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Index(c, rotation, dims, probes)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 1/2 to 1: no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, dims))
    return _scaled(np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dims))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows whose vector is not null or zero and whose components are all finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _scan(index: Index, k: int, block: int, eps: float, cells: int = 1_000_000):
    """For a piece of a list and the queries that probe it: the k nearest of each query.

    Queries go side by side, as many as make ``cells`` distances with the piece.
    """
    dims = index.dims

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.column("query_id").combine_chunks()
        if not len(left) or not len(right):
            return pa.table({"query_id": asked.slice(0, 0), "vec_id": asked.slice(0, 0), "score": pa.array([], pa.float64())})
        left = left.take(pc.sort_indices(left.column("vec_id")))  # so that a place tells which id is smaller
        ids = left.column("vec_id").combine_chunks()
        codes = np.asarray(pc.fill_null(pa.concat_arrays([ids, asked]).dictionary_encode().indices, -1))
        raw, raw_q = _matrix(left.column("v"), dims), _matrix(right.column("v"), dims)
        size, size_q = np.sqrt((raw * raw).sum(axis=1)), np.sqrt((raw_q * raw_q).sum(axis=1))
        x, q = (raw / size[:, None]) @ index.rotation, (raw_q / size_q[:, None]) @ index.rotation
        n, out = len(x), []
        for lo in range(0, len(q), max(1, cells // n)):
            own = slice(lo, lo + max(1, cells // n))
            z = q[own]
            part = np.zeros((len(z), n))
            part[codes[None, :n] == codes[n:][own][:, None]] = np.inf
            bound = np.full(len(z), np.inf)
            at_q, at_x = np.nonzero(np.isfinite(part))
            for d in range(0, dims, block):
                e = min(d + block, dims)
                if d == 0:
                    a, b = x[:, :e], z[:, :e]
                    part += np.maximum(0, (a * a).sum(axis=1)[None, :] + (b * b).sum(axis=1)[:, None] - 2 * (b @ a.T))
                else:
                    diff = x[at_x, d:e] - z[at_q, d:e]
                    part[at_q, at_x] += np.einsum("ij,ij->i", diff, diff)
                if e < dims and n > k:
                    # The whole distances of the k that look best bound the k-th best.
                    best = np.argpartition(part, k - 1, axis=1)[:, :k]
                    diff = x[best] - z[:, None, :]
                    whole = np.where(np.isfinite(np.take_along_axis(part, best, axis=1)), np.einsum("ijk,ijk->ij", diff, diff), np.inf)
                    bound = np.minimum(bound, whole.max(axis=1))
                    keep = part[at_q, at_x] * (dims / e) <= bound[at_q] * (1 + eps / np.sqrt(e)) ** 2 + 1e-12
                    part[at_q[~keep], at_x[~keep]] = np.inf
                    at_q, at_x = at_q[keep], at_x[keep]
            if n > k:  # room for ties and rounding, settled below in double precision
                cut = np.partition(part, k - 1, axis=1)[:, k - 1] + 1e-9
                keep = part[at_q, at_x] <= cut[at_q]
                at_q, at_x = at_q[keep], at_x[keep]
            scores = np.einsum("ij,ij->i", raw[at_x], raw_q[own][at_q]) / (size[at_x] * size_q[own][at_q])
            order = np.lexsort((at_x, -scores, at_q))
            at_q, at_x, scores = at_q[order], at_x[order], scores[order]
            nth = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
            out.append((at_q[nth < k] + lo, at_x[nth < k], scores[nth < k]))
        at_q, at_x, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": asked.take(pa.array(at_q)), "vec_id": ids.take(pa.array(at_x)), "score": pa.array(scores, pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 20_000, recall: float = 0.97, block: int = 16, eps: float = 2.1, piece: int = 4000, query_block: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, ties to the smaller id.

    queries: rows of vectors, known by the same id; a query is not its own neighbour, nor are rows of
    the same id. Null, zero and non-finite vectors take no part; vectors of different lengths have no
    cosine, so each length is a search of its own. If several rows share an id, each is a candidate,
    and a query is searched once for each different vector of its id. Empty tables give no rows.

    The centroids are fitted to at most ``sample_rows`` vectors, those with the least digests of
    their ids; every vector is indexed. There are as many lists as the root of the number of vectors,
    and at most a fortieth of ``sample_rows``. A query probes as many lists as the sample needs for
    ``recall``, see ``fit``: few if the vectors cluster, most if they do not. ``eps`` is the
    significance of the hypothesis test. Lists are cut into pieces of about ``piece`` vectors by
    digest, so a list that holds a third of all vectors is many tasks, and each piece sends k rows
    for each query that probes it. Beyond ``query_block`` queries a piece meets them block by block,
    each in its own task.
    """
    rows, wanted = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    kind = dict(rows.dtypes)["vec_id"]
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect()
    found = [_search(rows.where(F.size("v") == r["dims"]), wanted.where(F.size("v") == r["dims"]), r["dims"], r["count"], kind, k, sample_rows, recall, block, eps, piece, query_block) for r in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, wanted: DataFrame, dims: int, n: int, kind: str, k: int, sample_rows: int, recall: float, block: int, eps: float, piece: int, query_block: int) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one length: k rows for each query and each piece that it probes."""
    digest = F.md5(F.coalesce(F.col("vec_id").cast("string"), F.lit("")).cast("binary"))
    sample = rows.select(digest.alias("o"), "vec_id", "v").orderBy("o", "vec_id", "v").limit(sample_rows).toArrow()
    index = fit(_unit(_matrix(sample.column("v"), dims)), max(1, min(int(np.sqrt(n)), len(sample) // 40)), k=k, recall=recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column("v"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ index.centroids.T, axis=1), pa.int32()), b.column("vec_id"), b.column("v")], names=["list", "vec_id", "v"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column("v"), dims))
            near = np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")[:, : index.probes]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            for i in range(0, len(at), 50_000):
                some = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()[i : i + 50_000], pa.int32()), b.column("vec_id").take(pa.array(some)), b.column("v").take(pa.array(some))], names=["list", "query_id", "v"])

    stored = checkpointed(rows.mapInArrow(assign, f"list int, vec_id {kind}, v array<double>"))
    sizes = stored.groupBy("list").count().select("list", F.ceil(F.col("count") / piece).cast("int").alias("pieces"))
    wanted = checkpointed(wanted.dropDuplicates())
    blocks = max(1, -(-wanted.count() // query_block))
    turn = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    cut = stored.join(F.broadcast(sizes), "list").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces").withColumn("block", turn)
    asked = wanted.mapInArrow(probes, f"list int, query_id {kind}, v array<double>")
    dealt = asked.join(F.broadcast(sizes), "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return cut.groupBy("list", "piece", "block").cogroup(dealt.groupBy("list", "piece", "block")).applyInArrow(_scan(index, k, block, eps), f"query_id {kind}, vec_id {kind}, score double")
