"""Language-model scores by online logistic context mixing.

A text is its case-folded words and one end. The most frequent words, the end, and one escape for
each class of other words (by their last two bytes) have Huffman codes, so a token is a few binary
decisions. Each decision is predicted from several hashed contexts whose bit counts come
from all training rows: none, the last very frequent word (which tells the language), and the word
before; a match model says what followed that word last time in the same text. The predictions meet
in the logistic domain, weighted by a set of weights that the state of the match model selects, and
an adaptive probability map refines the result. Weights and map start from fixed values and learn
online through the whole text. After an escape comes the word's share in its class under add-one
counts, so the scores are probabilities of the same texts as the unigram base's.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed

CLASSES = 256
SLOTS = 1 << 18  #: of each hashed context, at least
MOST_SLOTS = 1 << 21
_RANGE = 1 << 15  #: counts that travel together
HINTS = 256  #: the most frequent words, which tell the language
GATES = 3
_CELLS = 2 * SLOTS + 32
_EPS = 1e-5
_PAIRS = 1 << 16  #: of a context and a symbol that are counted at once
_AT_ONCE = 1 << 15  #: tokens whose decisions are laid out at once
_HINT = tuple(map(np.uint32, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)))  #: factors of the hashes of a context
_BEFORE = tuple(map(np.uint32, (0x27D4EB2F, 0x165667B1, 0x9E3779B1)))
#: The class of a word by its last two bytes, then of a word of one byte.
_ENDINGS = np.array([zlib.crc32(bytes([a, b])) % CLASSES for a in range(256) for b in range(256)] + [zlib.crc32(bytes([a])) % CLASSES for a in range(256)], np.int64)
_WIDE = 52  #: bits that a float holds exactly
_BUCKETS = 25


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, how many each has). White space is space and 0x09 to 0x0D; A-Z is folded."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    offsets, found = lists.offsets.to_numpy(), lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(found), 0)  # white space at either end leaves an empty one
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return found.filter(real), np.diff(before[offsets])


def escape_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def huffman(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, begin, node, bit): symbol s has the bits bit[begin[s] : begin[s] + length[s]], each
    decided at the node of the same position. Nodes count from 0."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, at = [0] * (2 * n - 1), [0] * (2 * n - 1), n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j] = at, at, 1
        heapq.heappush(heap, (a + b, at))
        at += 1
    length, begin, node, bit = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    for s in range(n):
        path, x = [], s
        while x != at - 1:
            path.append((parent[x] - n, side[x]))
            x = parent[x]
        length[s], begin[s] = len(path), len(node)
        node += [p for p, _ in reversed(path)]
        bit += [b for _, b in reversed(path)]
    return length, begin, np.array(node, np.uint32), np.array(bit, np.int8)


@dataclass
class Model:
    """What the tasks need: its size is bounded by the vocabulary, the classes and the slots.

    The first ``coded`` words have codes of their own; then come the end and the escapes. The other
    words of the vocabulary are escaped, and their counts are at hand; those of rarer words are not.
    """

    ids: InitVar[dict[bytes, int]]
    coded: int
    classes: np.ndarray  # of each vocabulary word, and one more
    log_base: np.ndarray  # log10 of the base's probability of each vocabulary word, then of the end
    class_log: np.ndarray  # log10 of each class's share under the base
    code: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    node_stretch: np.ndarray
    names: pa.Array = field(init=False)  # of the vocabulary, by number
    aligned: np.ndarray = field(init=False)  # each symbol's code as a number of _WIDE bits, from the top
    table: np.ndarray | None = None  # stretch of each slot, or 16 times it in bytes
    slots: int = SLOTS
    #: For each gate the starting weights of the node, the two contexts, the match model, and the bias.
    weights: np.ndarray = field(default_factory=lambda: np.array([[0.1, 0.35, 0.65, 0.0, 0.0], [0.1, 0.3, 0.5, 0.5, 0.0], [0.1, 0.25, 0.4, 0.7, 0.0]], np.float32))

    def __post_init__(self, ids: dict[bytes, int]) -> None:
        self.names = pa.array(sorted(ids, key=ids.get), pa.binary())
        length, begin, _, bit = self.code
        if length.max(initial=0) > _WIDE:
            raise ValueError(f"a code has more than {_WIDE} bits")
        place = np.arange(len(bit)) - np.repeat(begin, length)
        self.aligned = np.bincount(np.repeat(np.arange(len(length)), length), weights=bit * 2.0 ** (_WIDE - 1 - place), minlength=len(length)).astype(np.int64)

    @property
    def cells(self) -> int:
        return 2 * self.slots + 32

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that the codes of symbols a and b have in common; _WIDE for the same symbol."""
        differ = np.take(self.aligned, a) ^ np.take(self.aligned, b)
        return (_WIDE - np.frexp(differ.astype(np.float64))[1]).astype(np.int8)


@dataclass
class Coding:
    """The texts of a column as symbols, with what the words say that have none of their own."""

    docs: list[np.ndarray]  # the symbols of each text, the end too
    sizes: np.ndarray  # words of each text
    number: np.ndarray  # of each word in the vocabulary, or -1
    of: np.ndarray  # the text of each word
    far: np.ndarray  # places of the words that are escaped
    classes: np.ndarray  # theirs
    rare: pa.Array  # the words outside the vocabulary


def coding(model: Model, column: pa.Array) -> Coding:
    found, sizes = words(column)
    number = pc.fill_null(pc.index_in(found, value_set=model.names), -1).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    far = np.flatnonzero((number < 0) | (number >= model.coded))
    kind = np.take(model.classes, number)  # the last one, of no word, for unknown words
    unknown = number < 0
    rare = found.filter(pa.array(unknown))
    if len(rare):
        _, at, data = rare.buffers()
        end = np.frombuffer(at, np.int32)[rare.offset + 1 : rare.offset + 1 + len(rare)]
        size, held = pc.binary_length(rare).to_numpy(), np.frombuffer(data, np.uint8)
        last = held[end - 1].astype(np.int64)
        kind[unknown] = _ENDINGS[np.where(size > 1, 256 * held[np.maximum(end - 2, 0)].astype(np.int64) + last, 65_536 + last)]
    classes = kind[far]
    s = np.full(len(number) + len(sizes), model.coded)
    inner = number.copy()
    inner[far] = model.coded + 1 + classes
    s[np.arange(len(number)) + of] = inner
    return Coding(np.split(s, np.cumsum(sizes + 1)[:-1]), sizes, number, of, far, classes, rare)


def _places(model: Model, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of all symbols of the documents laid end to end: the contexts and what the match model expects."""
    sizes = np.array([len(d) for d in docs])
    s = np.concatenate(docs)
    n = len(s)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(n)
    none = model.coded + 1 + CLASSES
    before = np.concatenate([[none], s[:-1]])
    before[start[start == at]] = none
    hint_at = np.maximum.accumulate(np.where(before < HINTS, at, -1))
    hint = np.where(hint_at >= start, before[np.maximum(hint_at, 0)], HINTS)
    # What followed the last occurrence of the symbol before, in the same document.
    key = np.repeat(np.arange(len(docs)), sizes) * (none + 1) + before
    wide = n.bit_length()
    order = np.sort((key << wide) | at)
    same = order[1:] >> wide == order[:-1] >> wide
    order &= (1 << wide) - 1
    last = np.full(n, -1)
    last[order[1:][same]] = order[:-1][same]
    guess = np.where((last >= 0) & (before != none), s[np.maximum(last, 0)], -1)
    # Whether that was right for the tokens before, up to two on end.
    r1 = np.concatenate([[False], (guess == s)[:-1]]) & (at > start)
    r2 = np.concatenate([[False], r1[:-1]]) & r1
    # A guess holds for a bit while its code agrees with all bits before: up to the bit in which the
    # two codes part, where what it expects is wrong.
    part = np.where(guess >= 0, model.common(np.maximum(guess, 0), s), -1).astype(np.int8)
    return {"symbol": s, "sizes": sizes, "hint": hint, "before": before, "part": part, "run": r1.astype(np.int8) + r2}


def _slot(model: Model, context: np.ndarray, node: np.ndarray, by: tuple[np.uint32, np.uint32, np.uint32]) -> np.ndarray:
    """The slot of each node in its context, of which ``context`` is by[0] times the number."""
    return ((context ^ (node * by[1])) * by[2]) >> np.uint32(32 - (model.slots.bit_length() - 1))


def bits(model: Model, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All binary decisions of the documents laid end to end, with what each predictor needs."""
    length, begin, node, bit = model.code
    t = _places(model, docs)
    s, sizes = t["symbol"], t["sizes"]
    n = len(s)
    sz = length[s]
    base = np.cumsum(sz) - sz
    every = np.arange(int(sz.sum()), dtype=np.int32)
    place = every + np.repeat((begin[s] - base).astype(np.int32), sz)
    j = every - np.repeat(base.astype(np.int32), sz)
    b, nd = np.take(bit, place), np.take(node, place)
    parting = np.repeat(t["part"], sz)
    active = j <= parting
    cell = np.repeat((1 + 2 * t["run"]).astype(np.int8), sz)
    gate = active * (np.int8(1) + (cell > 1))
    match = np.int32(2 * model.slots) + active * (cell + (b ^ (j == parting)))
    h1, h2 = (_slot(model, np.repeat(t[c].astype(np.uint32) * by[0], sz), nd, by) for c, by in (("hint", _HINT), ("before", _BEFORE)))
    return {"bit": b, "node": nd, "h1": h1.astype(np.int32), "h2": h2.astype(np.int32) + np.int32(model.slots), "match": match.astype(np.int32), "gate": gate.astype(np.int8), "bits": np.add.reduceat(sz, np.cumsum(sizes) - sizes) if n else np.zeros(0, np.int64)}


def tally(model: Model, docs: list[np.ndarray], n: np.ndarray) -> None:
    """Adds the documents' bit counts to the cells of all contexts; n[2 c + b] counts bit b in cell c.

    These are the counts of all decisions that bits() gives. A symbol that occurs again in one context
    is looked up once for all times, and the match model's cells are counted by symbols.
    """
    length, begin, node, bit = model.code
    t = _places(model, docs)
    s, part = t["symbol"], t["part"].astype(np.int64)
    several = model.coded + 2 + CLASSES
    for name, by, low in (("hint", _HINT, 0), ("before", _BEFORE, model.slots)):
        key, times = np.unique(t[name] * several + s, return_counts=True)
        for k in range(0, len(key), _PAIRS):
            context, symbol = np.divmod(key[k : k + _PAIRS], several)
            sz = length[symbol]
            place = np.arange(int(sz.sum())) + np.repeat(begin[symbol] - (np.cumsum(sz) - sz), sz)
            cell = _slot(model, np.repeat(context.astype(np.uint32) * by[0], sz), np.take(node, place), by).astype(np.int64) + low
            np.add.at(n, cell * 2 + np.take(bit, place), np.repeat(times[k : k + _PAIRS].astype(n.dtype), sz))
    code, sz, first = np.take(model.aligned, s), length[s], 2 * model.slots
    agreed = np.clip(part, 0, sz)  # bits that the guess has right
    ones = np.bitwise_count(code >> (_WIDE - agreed)).astype(np.int64)
    wrong = (part >= 0) & (part < sz)
    came = (code >> (_WIDE - 1 - np.where(wrong, part, 0))) & 1  # in the bit where the codes part
    rest = np.bitwise_count(code) - ones - wrong * came  # ones among the bits without a guess
    found = np.zeros(2 * (_CELLS - 2 * SLOTS), np.int64)
    found[:2] = (sz - agreed - wrong - rest).sum(), rest.sum()
    for run in range(3):
        those = (part >= 0) & (t["run"] == run)
        c = 2 * (1 + 2 * run)  # what is expected is 0; the next cell is for 1
        for expected, right in ((0, agreed - ones), (1, ones)):
            found[c + 2 * expected + expected] += right[those].sum()
            found[c + 2 * expected + 1 - expected] += (those & wrong & (came != expected)).sum()
    n[2 * first :] += found.astype(n.dtype)


def stretched(n: np.ndarray) -> np.ndarray:
    """The cells' predictions in the logistic domain, in sixteenths: a byte each, so that a table stays near the processor."""
    n0, n1 = n[::2], n[1::2]
    return np.clip(np.rint(16 * np.log((n1 + 0.4) / (n0 + 0.4))), -127, 127).astype(np.int8)


def predictions(model: Model, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """What mix needs of all decisions of the documents, a few bytes each; made of few documents at a time."""
    parts, some, total = [], [], 0
    for k, d in enumerate(docs):
        some.append(d)
        total += len(d)
        if total >= _AT_ONCE or k == len(docs) - 1:
            parts.append(said(model, bits(model, some)))
            some, total = [], 0
    return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]} if parts else said(model, bits(model, [np.zeros(0, np.int64)]))


def said(model: Model, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The decisions with each predictor's word in place of its cell."""
    return {"bit": x["bit"], "gate": x["gate"], "node": np.take(model.node_stretch, x["node"]), **{c: np.take(model.table, x[c]) for c in ("h1", "h2", "match")}, "bits": x["bits"]}


def mix(model: Model, x: dict[str, np.ndarray], rate: float = 0.02, block: int = 64, lanes_bits: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each document's bits, mean of the weights the documents ended with).

    Documents of like length run side by side, a block of bits at a step; after each step a document's
    weights and its probability map move by the errors of the step, and they are carried to its end.
    Every block of every document has ``block`` bits but its last.
    """
    return mixed(model, said(model, x), rate, block, lanes_bits)


def mixed(model: Model, x: dict[str, np.ndarray], rate: float = 0.02, block: int = 64, lanes_bits: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
    """mix, of what predictions() gives."""
    sizes = x["bits"]
    start = np.cumsum(sizes) - sizes

    def windows(name: str) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([x[name], np.zeros(block, x[name].dtype)]), block)

    bit, gate = windows("bit"), windows("gate")
    heard = [windows(c) for c in ("node", "h1", "h2", "match")]
    unit = [np.float32(1 / 16 if t.dtype == np.int8 else 1) for t in heard]
    cost = np.zeros(len(sizes))
    half = _BUCKETS // 2
    identity = (1 / (1 + np.exp(-(np.arange(_BUCKETS) - half) / 1.5))).astype(np.float32)
    total, pace = np.zeros(model.weights.shape), np.float32(rate)
    order = np.argsort(sizes, kind="stable")
    gates = np.arange(GATES, dtype=np.int8)[None, :, None]
    most = max(1, lanes_bits // block)
    for members in (order[k : k + most] for k in range(0, len(order), most)):
        lanes = len(members)
        w = np.repeat(model.weights[None], lanes, axis=0)
        apm = np.tile(identity, lanes)
        spent = np.zeros(lanes)
        own, begin = sizes[members], start[members]
        f = np.ones((lanes, 5, block), np.float32)
        shift = np.arange(lanes, dtype=np.int32)[:, None] * _BUCKETS + half
        for i in range(0, int(own[-1]), block):
            done = int(np.searchsorted(own, i, side="right"))  # the shorter documents come first
            at, now = begin[done:] + i, f[done:]
            y = bit[at].astype(np.float32)
            for q in range(4):
                np.multiply(heard[q][at], unit[q], out=now[:, q])
            chosen = (gate[at][:, None] == gates).astype(np.float32)
            st = np.matmul(w[done:], now)
            st *= chosen
            st = st[:, 0] + st[:, 1] + st[:, 2]
            np.clip(st, -11, 11, out=st)
            p = np.exp(-st)
            p += 1
            np.reciprocal(p, out=p)
            st *= np.float32(1.5)
            np.clip(st, -half, half, out=st)
            cell = np.rint(st, out=st).astype(np.int32) + shift[done:]
            mapped = np.take(apm, cell)
            refined = np.float32(0.6) * p + np.float32(0.4) * mapped
            np.clip(refined, _EPS, 1 - _EPS, out=refined)
            refined += y
            refined -= 1
            np.abs(refined, out=refined)  # the chance of the bit that came
            np.subtract(y, p, out=p)
            np.subtract(y, mapped, out=mapped)
            if (short := int(np.searchsorted(own[done:], i + block))):  # the last blocks of some documents
                beyond = np.arange(i, i + block) >= own[done : done + short, None]
                refined[:short][beyond] = 1
                p[:short][beyond] = 0
                mapped[:short][beyond] = 0
            spent[done:] += np.log(refined, out=refined).sum(axis=1)
            chosen *= p[:, None]
            w[done:] += pace * np.matmul(chosen, now.transpose(0, 2, 1))
            apm += np.float32(0.02) * np.bincount(cell.ravel(), weights=mapped.ravel(), minlength=len(apm)).astype(np.float32)
            np.clip(apm, 1e-4, 1 - 1e-4, out=apm)
        cost[members] = spent / np.log(10)
        total += w.sum(axis=0)
    return cost, (total / max(1, len(order))).astype(np.float32)


def _parts(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in order in slices of about ``most`` bytes of text and at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all rows, without the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, 0)):
            found = pc.value_counts(words(part.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["token", "n"])

    return docs.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 16, coded: int = 1 << 16) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    learn: a condition on doc_id for the training rows. Token counts and all context counts are taken
    over all of them, in full. The words with codes of their own (the whole vocabulary unless ``coded``
    says less), the classes and the slots, which grow with the training rows up to ``MOST_SLOTS``, bound
    the size of the model, as every model has one. The counts of the ``vocabulary`` most frequent words go
    to the tasks; those of all others are kept exactly too, never leave the cluster, and meet the
    documents' rare words in a shuffle join.

    base_score: sum over tokens of log10((c + 1) / (N + V + 1)). score: log10 of the text's
    probability under the model. n_bytes: of the text in UTF-8. bits_per_byte: the score in bits over
    n_bytes and one, which stands for the end. Null texts are empty: one token, the end. Without training rows every
    token is unknown. Rows that repeat are scored alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(learn)
    counts = checkpointed(token_counts(train))
    n_words, n_types = counts.agg(F.sum("n"), F.count("*")).first()
    n_docs = train.count()
    total, distinct = (n_words or 0) + n_docs, n_types + (n_docs > 0)
    denominator = float(total + distinct + 1)
    top = counts.orderBy(F.desc("n"), "token").limit(vocabulary).toArrow()
    tokens = top.column("token").to_pylist()
    names = [t.encode("utf-8", "surrogatepass") for t in tokens]
    seen = np.array(top.column("n").to_pylist(), dtype=np.float64)
    frequent = docs.sparkSession.createDataFrame(pa.table({"token": pa.array(tokens, pa.string())}))
    rare = counts.join(F.broadcast(frequent), "token", "left_anti")
    klass = (F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)) % CLASSES).cast("int")
    coded = min(coded, len(names))
    share, weight = np.full(CLASSES, 1.0), np.full(CLASSES, 0.5)
    for w, c in zip(names[coded:], seen[coded:].tolist(), strict=True):
        share[escape_class(w)] += c + 1
        weight[escape_class(w)] += c
    for r in rare.groupBy(klass.alias("k")).agg(F.sum(F.col("n") + 1).alias("a"), F.sum("n").alias("n")).collect():
        share[r["k"]] += r["a"]
        weight[r["k"]] += r["n"]
    weights = np.concatenate([seen[:coded] + 0.5, [n_docs + 0.5], weight])
    model = Model({w: i for i, w in enumerate(names)}, coded, np.array([*map(escape_class, names), 0]), np.log10((np.append(seen, n_docs) + 1) / denominator), np.log10(share / denominator), huffman(weights.tolist()), np.zeros(0))
    model.slots = min(MOST_SLOTS, max(SLOTS, 1 << int(n_words or 0).bit_length()))
    model.node_stretch = _node_stretch(model, weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * model.cells, np.uint32)
        for batch in batches:
            for part in _parts(batch, 0):
                tally(model, coding(model, part.column(0)).docs, n)
        for k in range(0, len(n), _RANGE):
            if (part := n[k : k + _RANGE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _RANGE], pa.int32()), pa.array([bytes(pa.compress(part.tobytes(), "zstd"))], pa.binary())], names=["k", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = min(_RANGE, 2 * model.cells - k * _RANGE)
                n = np.frombuffer(pa.decompress(data, 4 * size, "zstd"), np.uint32).astype(np.int64)
                sums[k] = sums[k] + n if k in sums else n
        for k, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["k", "n"])

    # A task's counts leave it as a few compressed ranges, and a range is added up in one task.
    blocks = train.select("text").mapInArrow(count, "k int, n binary").repartition("k").mapInArrow(add, "k int, n binary").collect()
    n = np.zeros(2 * model.cells, np.int64)
    for r in blocks:
        part = np.frombuffer(bytes(r["n"]), np.int64)
        n[r["k"] * _RANGE : r["k"] * _RANGE + len(part)] = part
    model.table = stretched(n)
    known_end = int(n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, 2)):
            c, texts = coding(model, part.column(2)), part.num_rows
            logp, _ = mixed(model, predictions(model, c.docs))
            near = c.number >= 0
            sums = lambda of, x=None: np.bincount(of, weights=x, minlength=texts)
            base = sums(c.of[near], model.log_base[c.number[near]]) + model.log_base[-1]
            escaped = c.number >= model.coded
            inside = logp + sums(c.of[escaped], model.log_base[c.number[escaped]]) - sums(c.of[c.far], model.class_log[c.classes])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(c.of[~near]))]), pa.int32()), c.rare)
            n_bytes = pc.fill_null(pc.binary_length(part.column(2)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, (c.sizes + 1, sums(c.of[near]) + known_end, base, inside)), n_bytes, lists], names=["doc_id", "th", "n_tokens", "n_near", "base", "model", "n_bytes", "rare"])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    scored = keyed.mapInArrow(run, f"doc_id {kind}, th long, n_tokens long, n_near long, base double, model double, n_bytes long, rare array<binary>")
    # The rare words of each text meet their counts; a text's own figures go with the first of them,
    # and texts without rare words are dealt at random. Rows that repeat add up, share the sums, and are
    # dealt out again.
    spread = scored.select("*", F.posexplode_outer("rare").alias("i", "word"))
    own = F.coalesce(F.col("i"), F.lit(0)) == 0
    figures = ("n_tokens", "n_near", "base", "model", "n_bytes")
    said = spread.select("doc_id", "th", F.col("word").cast("string").alias("token"), F.when(own, F.lit(1).cast("long")).alias("copies"), *[F.when(own, F.col(c)).alias(c) for c in figures])
    # A left join may not deal null keys at random, so each gets a token of its own that no word is.
    apart = F.coalesce(F.col("token"), F.concat(F.lit(" "), F.col("th").cast("string"), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    met = said.withColumn("key", apart).join(rare.withColumnRenamed("token", "key"), "key", "left").withColumn("log", F.when(F.col("token").isNotNull(), F.log10((F.coalesce("n", F.lit(0)) + 1) / denominator)))
    sums = met.groupBy("doc_id", "th").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in figures], F.coalesce(F.sum("log"), F.lit(0.0)).alias("log"), F.count(F.when(F.col("n") > 0, 1)).alias("known"))
    each = sums.select("*", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_"))
    share_of = lambda c: (c / F.col("copies")).cast("long")
    out = each.select("doc_id", share_of(F.col("n_tokens")).alias("n_tokens"), share_of(F.col("n_near") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), ((F.col("base") + F.col("log")) / F.col("copies")).alias("base_score"), ((F.col("model") + F.col("log")) / F.col("copies")).alias("score"), share_of(F.col("n_bytes")).alias("n_bytes"))
    return out.withColumn("bits_per_byte", F.col("score") * float(-np.log2(10)) / (F.col("n_bytes") + 1))


def _node_stretch(model: Model, weights: np.ndarray) -> np.ndarray:
    """The order-0 prediction of each node: the weight of the symbols on either side."""
    length, _, node, bit = model.code
    if not len(node):
        return np.zeros(1, np.float32)
    w = np.repeat(weights, length)
    n1 = np.bincount(node, weights=w * bit)
    n0 = np.bincount(node, weights=w * (1 - bit))
    return np.clip(np.log(np.maximum(n1, 1e-9) / np.maximum(n0, 1e-9)), -11, 11).astype(np.float32)
