"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed

#: Bytes that are no part of a word become a space and A-Z lower case; bytes of UTF-8 from 0x80 up stay.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(item: list[bytes], length: int) -> list[tuple[bytes, ...]]:
    """All runs of ``length`` words; a shorter item that is not empty is one window."""
    return [tuple(item[i : i + length]) for i in range(len(item) - length + 1)] or ([tuple(item)] if item else [])


class Matcher:
    """Shift tables and suffix-hash buckets for the windows of some items, one pair for each window length.

    patterns: (words, name) of each item, whose windows have ``length`` words, or all of a shorter
    item's; without a length each item is one window. Item words are numbered, and an item is kept once, as its numbers laid end to end with those of
    the others; a window is where it ends. A window of m words is looked at through its blocks of up to
    two words. The table of a length has for a block how far the search may move when the text ends in
    it, as a negative number: the distance of the block's last occurrence in any window from the
    window's end; a block in no window allows m - b + 1. At distance 0 it has the number of a bucket,
    whose windows end in that block and are compared word for word.
    """

    def __init__(self, patterns: Iterable[tuple[Sequence[bytes], str]], length: int | None = None):
        self.ids: dict[bytes, int] = {}
        self.flat: array = array("i")
        self.owner: array = array("i")  # of each position
        self.names: list[str] = []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # first and last end of windows, by their length
        for item, name in patterns:
            w = [self.ids.setdefault(x, len(self.ids)) for x in item]
            if w:
                at, m = len(self.flat), min(length or len(w), len(w))
                spans[m].append((at + m, at + len(w)))
                self.flat.extend(w)
                self.owner.extend([len(self.names)] * len(w))
                self.names.append(name)
        self.tables = []
        for m, found in sorted(spans.items()):
            b = min(2, m)
            table: dict[int, int] = {}
            buckets: list[list[int]] = []
            for first, last in found:
                for end in range(first - m + b, last + 1):
                    key, distance = self._block(end, b), max(0, first - end)
                    had = table.get(key)
                    if distance:
                        if had is None or had < -distance:
                            table[key] = -distance
                    elif had is None or had < 0:
                        table[key] = len(buckets)
                        buckets.append([end])
                    else:
                        buckets[had].append(end)
            self.tables.append((m, b, table, buckets))

    def _block(self, end: int, b: int) -> int:
        return self.flat[end - 2] << 32 | self.flat[end - 1] if b == 2 else self.flat[end - 1]

    def search(self, text: list[bytes]) -> tuple[list[int], set[str]]:
        """Flat list of [start, end) word positions, one pair for each place that matches, and the items met."""
        spans: list[int] = []
        items: set[str] = set()
        known = self.ids.get
        t = array("i", [known(w, -1) for w in text])
        n, flat = len(t), self.flat
        for m, b, table, buckets in self.tables:
            skip, i = m - b + 1, m
            look = table.get
            while i <= n:
                last = t[i - 1]
                if last < 0:  # a word of no item: no window reaches over it
                    i += m
                    continue
                at = look(t[i - 2] << 32 | last if b == 2 else last)
                if at is None:
                    i += skip
                    continue
                if at < 0:
                    i -= at
                    continue
                own = t[i - m : i]
                hits = {self.owner[e - 1] for e in buckets[at] if flat[e - m : e] == own}
                if hits:
                    spans += (i - m, i)
                    items.update(self.names[k] for k in hits)
                i += 1
        return spans, items


def covered(spans: list[int]) -> int:
    """Number of positions that lie in any span."""
    total = reach = 0
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def _scan(items: Broadcast, length: int):
    """A pass over batches whose last four columns are text, n_words, spans and items.

    The tables are built once in each Python worker and kept beside the broadcast value there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        if "matcher" not in held:
            held["matcher"] = Matcher(((words(t), name) for name, t in zip(held["names"], held["texts"], strict=True)), length)
        matcher = held["matcher"]
        for batch in batches:
            n_words, spans, met_items = [], [], []
            texts, _, spans0, items0 = (c.to_pylist() for c in batch.columns[-4:])
            for text, before, had in zip(texts, spans0, items0, strict=True):
                w = words(text)
                found, met = matcher.search(w)
                n_words.append(len(w))
                spans.append(merged([*before, *found]))
                met_items.append(sorted({*had, *met}))
            made = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(met_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], names=batch.schema.names)

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[dict]:
    """All items with a text, in blocks of names and texts of about ``block_bytes`` bytes at most."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    for k in range(parts):
        share = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
        names, texts = [], []
        for r in share.toLocalIterator():
            names.append(r["item"] or "")
            texts.append(r["text"])
        yield {"names": names, "texts": texts}


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, block_bytes: int = 4 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, ``keep``, n_words, spans (flat, merged [start, end) word positions), items.

    Words are maximal runs of digits, letters and non-ASCII characters after A-Z is folded. Null and
    wordless texts have no words and no hits; rows that repeat are each searched. An item whose id is
    null counts under the empty name. The items are the stated query set: their texts are broadcast in
    blocks of ``block_bytes``, one pass over the documents for each block, so a larger benchmark costs
    passes and not memory; a worker holds about 60 bytes of tables for a byte of item text. An empty
    benchmark hits nothing.
    """
    now = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    context = docs.sparkSession.sparkContext
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text_col, block_bytes)):
        if k:
            now = checkpointed(now)
        now = now.mapInArrow(_scan(context.broadcast(block), length), now.schema)
    return now.select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], "n_words", "spans", "items")


def n_hit(spans):
    """Words under the merged spans, as a column."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def items_digest(items) -> object:
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def digest_of(items: Iterable[str]) -> str:
    """The same, outside Spark."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
