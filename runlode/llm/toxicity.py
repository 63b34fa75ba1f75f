"""Toxic spans by a linear-chain conditional random field, learned from documents' labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed
from runlode.llm.quality import agreed

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def _lowered(text: str) -> str:
    """The text in lower case if that keeps every character's place, else the text as it is."""
    low = text.lower()
    return low if len(low) == len(text) else text


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in TOKEN.findall(_lowered(text or ""))]


def features(word: str) -> tuple[str, ...]:
    """Of one token: itself, its first 3 to 6 and its last 4 characters."""
    n = len(word)
    return ("w" + word, *[f"{k}<{word[:k]}" for k in range(3, 7) if n > k], *(["4>" + word[-4:]] if n > 4 else []))


def forward_backward(e: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: float, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """P(tag 1) of each token of documents laid end to end, and P(tags a, b) of each and the one before.

    e: log-odds of tag 1 from the token's features. starts: positions of the documents' first tokens.
    trans[a, b]: weight of tag b after a. first: weight of tag 1 at a start. At a start the step
    forgets what was before, so one pass serves all documents: within blocks of tokens the steps'
    2 x 2 products are formed side by side, one short loop carries the message from block to block,
    and a second side-by-side pass gives every token its message.
    """
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    columns = -(-n // block)
    size = columns * block
    odds = np.exp(np.clip(np.concatenate([e, np.zeros(size - n)]), -30, 30))
    t = np.exp(trans)
    is_start = np.zeros(size, bool)
    is_start[starts] = True
    steps = np.empty((size, 2, 2))
    steps[:] = t
    steps[is_start] = np.array([[1.0, np.exp(first)]] * 2)
    ahead = steps.copy()
    ahead[:, :, 1] *= odds[:, None]  # message row vector times ahead[i]
    back = np.ones((size, 2, 2))
    nxt = steps[1:].copy()
    nxt[:, :, 1] *= odds[1:, None]
    back[: size - 1] = nxt
    back[:-1][is_start[1:]] = 1.0  # nothing after a document's last token
    if n < size:
        back[n - 1 :] = 1.0
    alpha = _scan(ahead.reshape(columns, block, 2, 2))
    reverse = np.ascontiguousarray(back[::-1].transpose(0, 2, 1))
    beta = _scan(reverse.reshape(columns, block, 2, 2))[::-1]
    p = alpha * beta
    pair = np.ones((n, 2, 2)) / 4
    pair[1:] = alpha[: n - 1, :, None] * ahead[1:n] * beta[1:n, None, :]
    pair /= pair.sum(axis=(1, 2))[:, None, None]
    return (p[:, 1] / p.sum(axis=1))[:n], pair


def _scan(m: np.ndarray) -> np.ndarray:
    """Messages v_i = v_(i-1) m_i / norm, from v = (1, 1), over (columns, block) matrices in order."""
    columns, block = m.shape[:2]
    a, b, c, d = (np.ascontiguousarray(m[:, :, i, j].T) for i in (0, 1) for j in (0, 1))
    p, q, r, s = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for i in range(block):
        p, q, r, s = p * a[i] + q * c[i], p * b[i] + q * d[i], r * a[i] + s * c[i], r * b[i] + s * d[i]
        if i % 4 == 3:  # 4 steps of at most e^30 and e^10 each stay far from overflow
            scale = 1.0 / (p + q + r + s)
            p, q, r, s = p * scale, q * scale, r * scale, s * scale
    enter = np.empty((2, columns))
    x = y = 0.5
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[0, k], enter[1, k] = x, y
        x, y = x * pk + y * rk, x * qk + y * sk
        total = x + y
        x, y = x / total, y / total
    out = np.empty((columns, block, 2))
    x, y = enter
    for i in range(block):
        x, y = x * a[i] + y * c[i], x * b[i] + y * d[i]
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
        out[:, i, 0], out[:, i, 1] = x, y
    return out.reshape(columns * block, 2)


@dataclass
class Model:
    """Feature weights (tag 1 against 0), transition weights, and the bias in ``weights['']``."""

    weights: dict[str, float]
    trans: np.ndarray
    first: float
    prior: float
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        cache, weigh, bias = self.cache, self.weights.get, self.weights.get("", 0.0)
        if len(cache) > 400_000:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = bias + sum(weigh(f, 0.0) for f in features(w))
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        flat = [w for d in docs for w in d]
        p, _ = forward_backward(self.emissions(flat), begin[sizes > 0], self.trans, self.first)
        return [p[a:b] for a, b in zip(begin, ends, strict=True)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}


def markers(docs: list[np.ndarray], words: list[str], toxic: list[bool], support: int = 6, purity: float = 0.98) -> np.ndarray:
    """Which words mark toxicity, learned from document labels.

    docs: word numbers. A feature is a marker if at least ``support`` toxic documents have it and,
    both classes weighed as equally large, the share ``purity`` of those that have it are toxic. A
    word with a marker is one. A clean document counts once for each of its words that has the
    feature, which only makes markers purer. Toxic documents that look like copies of an earlier one,
    by two of four least hashes of their long words, do not count again: a group of copies would make
    markers of all its words.
    """
    seen = np.zeros((2, len(words)), np.int64)
    have: Counter = Counter()
    sketches: set[tuple[int, int]] = set()

    def fresh(own_words: list[str]) -> bool:
        h = np.array([zlib.crc32(w.encode()) for w in own_words if len(w) > 8] or [zlib.crc32(" ".join(sorted(own_words)).encode())], dtype=np.uint64)
        own = {(k, int((h * np.uint64(a) % np.uint64(4294967291)).min())) for k, a in enumerate((1, 2654435761, 2246822519, 3266489917))}
        new = len(own & sketches) < 2
        sketches.update(own)
        return new

    for d, y in zip(docs, toxic, strict=True):
        ids = np.unique(d)
        seen[int(y), ids] += 1
        if y and len(ids):
            own = [words[i] for i in ids.tolist()]
            if fresh(own):
                have.update({f for w in own for f in features(w)})
    likely = {f for f, k in have.items() if k >= support}
    clean: Counter = Counter()
    for i in np.flatnonzero(seen[0]).tolist():
        for f in features(words[i]):
            if f in likely:
                clean[f] += int(seen[0, i])
    n0, n1 = max(1, toxic.count(False)), max(1, toxic.count(True))
    found = {f for f in likely if have[f] / n1 >= purity * (have[f] / n1 + (clean[f] + 0.5) / n0)}
    out = np.zeros(len(words), bool)
    for i in np.flatnonzero(seen[1]).tolist():
        out[i] = not found.isdisjoint(features(words[i]))
    return out


def train(docs: Iterable[tuple[list[str], bool]], per_class: int = 400, rounds: int = 60, rate: float = 0.5, decay: float = 0.05, prior: float = 0.5) -> Model:
    """A model from (tokens, toxic) pairs, which are read once.

    Marked words of toxic documents are the tagged tokens. The conditional likelihood of the tags of
    the first ``per_class`` documents of each class is maximised with Adam; the gradient of each
    weight is its observed count less its expected count under the marginals. Weights are kept for the
    features of tagged words; those that only clean words have are left to the bias. Documents of one
    class only make a model that gives every word that class.
    """
    numbers: dict[str, int] = {}
    coded: list[np.ndarray] = []
    toxic: list[bool] = []
    for tokens_, y in docs:
        coded.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens_), np.int32, len(tokens_)))
        toxic.append(y)
    if not any(toxic) or all(toxic):
        return Model({"": 10.0 if any(toxic) else -10.0}, np.zeros((2, 2)), 0.0, prior)
    words = list(numbers)
    marked = markers(coded, words, toxic)
    room = {True: per_class, False: per_class}
    chosen = []
    for i, flag in enumerate(toxic):
        if room[flag] and len(coded[i]):
            room[flag] -= 1
            chosen.append(i)
    flat = np.concatenate([coded[i] for i in chosen]).astype(np.int64)
    sizes = np.array([len(coded[i]) for i in chosen])
    y = (marked[flat] & np.repeat([toxic[i] for i in chosen], sizes)).astype(np.float64)
    used, ids = np.unique(flat, return_inverse=True)
    vocabulary = [words[i] for i in used.tolist()]
    names = {f: j + 1 for j, f in enumerate(sorted({f for i in np.flatnonzero(marked).tolist() for f in features(words[i])}))}
    owner, feature = [], []
    for i, w in enumerate(vocabulary):
        got = [0, *[names[f] for f in features(w) if f in names]]
        owner += [i] * len(got)
        feature += got
    owner, feature = np.array(owner), np.array(feature)
    starts = np.cumsum(sizes) - sizes
    linked = np.ones(len(flat), bool)
    linked[starts] = False
    theta = np.zeros(len(names) + 1 + 5)
    theta[0] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.bincount(ids, weights=y, minlength=len(vocabulary))
    observed = np.bincount(feature, weights=seen[owner], minlength=len(names) + 1)
    pairs = np.flatnonzero(linked)
    before, after = y[pairs - 1], y[pairs]
    told = np.array([[((1 - before) * (1 - after)).sum(), ((1 - before) * after).sum()], [(before * (1 - after)).sum(), (before * after).sum()]])
    for step in range(1, rounds + 1):
        w = theta[: len(names) + 1]
        trans = theta[-5:-1].reshape(2, 2)
        by_word = np.bincount(owner, weights=w[feature], minlength=len(vocabulary))
        e = by_word[ids]
        p, pair = forward_backward(e, starts, trans, theta[-1])
        expected = np.bincount(feature, weights=np.bincount(ids, weights=p, minlength=len(vocabulary))[owner], minlength=len(names) + 1)
        joint = pair[pairs].sum(axis=0)
        grad = np.concatenate([observed - expected, (told - joint).ravel(), [(y[starts] - p[starts]).sum()]]) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = {f: float(theta[j]) for f, j in names.items()} | {"": float(theta[0])}
    return Model(weights, theta[-5:-1].reshape(2, 2), float(theta[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = 1200, clean_docs: int = 3600, max_chars: int = 20_000_000, field_docs: int = 400) -> Model:
    """A model of at most ``toxic_docs`` and ``clean_docs`` labelled documents, a documented bound.

    usable: a condition on id_col in labels. The documents are those with the least digests of their
    ids, then of their texts; in that order, whole texts up to ``max_chars`` characters are learned
    from, and no more than those leave the tables. Marker words are learned from all of them, the
    field's weights from the first ``field_docs`` of each class. Labels that are null or neither 0 nor
    1 take no part, nor do ids with both labels; of rows that repeat one is learned from.
    """
    rows = agreed(labels, usable, id_col, label_col)
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    chosen = [r for y, most in ((1, toxic_docs), (0, clean_docs)) for r in rows.where(F.col("label") == y).orderBy(order, "_id").limit(most).collect()]
    if not chosen:
        return train([])
    picked = docs.sparkSession.createDataFrame(chosen, rows.schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(picked), "_id").select("label", order.alias("o"), F.xxhash64("_text").alias("h"), F.length("_text").cast("long").alias("n"), F.col("_text").alias("text"))
    found = checkpointed(found)
    # An id may have any number of rows: they are made one a text, and cut to the bounds before any text leaves.
    first = Window.partitionBy("label").orderBy("o", "h")
    ranked = found.groupBy("label", "o", "h", "n").agg(F.count("*").alias("copies")).withColumn("k", F.row_number().over(first))
    size, fits = 0, []
    for r in ranked.where(F.col("k") <= F.when(F.col("label") == 1, toxic_docs).otherwise(clean_docs)).orderBy("o", "h", "label").collect():
        if size + r["n"] <= max_chars:
            size += r["n"]
            fits.append((r["label"], r["o"], r["h"]))
    if not fits:
        return train([])
    keys = docs.sparkSession.createDataFrame(fits, "label int, o string, h long")
    texts = found.join(F.broadcast(keys), ["label", "o", "h"]).groupBy("label", "o", "h").agg(F.min("text").alias("text"))
    known = sorted((r["o"], r["h"], bool(r["label"]), r["text"]) for r in texts.collect())
    return train(((tokens(t), y) for _, _, y, t in known), field_docs, prior=ones / n)


def spans_of(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Offsets of runs of tokens whose marginal reaches the threshold; code points, end exclusive."""
    out: list[dict] = []
    at = [m.span() for m in TOKEN.finditer(_lowered(text))]
    last = -2
    for i in np.flatnonzero(p >= threshold).tolist():
        if i == last + 1:
            out[-1]["end"], out[-1]["p"] = at[i][1], max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": at[i][0], "end": at[i][1], "p": float(p[i])})
        last = i
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, block_chars: int = 2_000_000) -> DataFrame:
    """For each row of docs: doc_id, score, spans (start, end, p) of the tokens tagged toxic.

    score: the chance that some token is toxic, from the largest marginal; null and wordless texts
    score 0. Texts are read whole, ``block_chars`` characters at a time and at least one text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores: list[float] = []
            spans: list[list[dict]] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= block_chars):
                    size += len(texts[j] or "")
                    j += 1
                part = texts[i:j]
                for text, p in zip(part, model.marginals([tokens(t) for t in part]), strict=True):
                    top = float(p.max()) if len(p) else 0.0
                    scores.append(top)
                    spans.append(spans_of(text, p, threshold) if top >= threshold else [])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
