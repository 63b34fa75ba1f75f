"""Near copies by SimHash and by the exact Jaccard similarity of word shingles, in DataFrame operations only.

Two texts are near copies if their sets of five-word shingles have a similarity of 4/5 or more. What
SimHash puts together is checked by that similarity, and what passes is connected from the start.
What SimHash misses is found exactly: in any one order of all shingles, two such sets of n shingles
share one of the first n - ceil(4n/5) + 1 of each, so sets that meet in a shingle of their prefixes
are all the candidates there are. The order is by hash, shingles that many texts have last. SimHash
alone gives no such cover here: near copies differ in up to 13 of 64 bits, which would take 2^14 tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlode.llm import simhash
from runlode.llm.common import checkpointed, fold_case, known, one_of_each, space_words, sweep
from runlode.llm.graph import SMALL, components

#: A shingle in the low parts of more sets than this comes last in the order; any number gives the same links.
HEAVY = 32
#: The most nodes that are broadcast, by their keys of some 50 bytes each; more are joined in a shuffle.
FEW = 100_000
#: Longs of a bitmap of a set; any number gives the same links, more tell more sets apart.
LONGS = 8


def _kept(df: DataFrame) -> DataFrame:
    """The rows, checkpointed; what the checkpoints before it left behind goes first."""
    sweep(df.sparkSession)
    return checkpointed(df)


def _some(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of these nodes, each named once in ``nodes`` (node)."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi")


def shingle_set(text: Column, width: int = 5) -> Column:
    """Sorted distinct XXH64 values of the shingles; a shorter text is one shingle."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array(F.xxhash64(w)))

    return F.sort_array(F.array_distinct(F.transform(F.array(space_words(fold_case(text))), hashed)[0]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")).alias("lead"), F.col(text_col).alias("text"))


def _full(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, s): the whole sets of ``nodes`` (node, lead), from the texts again.

    Up to FEW nodes are broadcast, so that only their own texts are dealt out; more meet the texts in a shuffle.
    """
    few = nodes.count() <= FEW
    keys = nodes.select("node", known(F.col("lead.doc_id")).alias("k"), F.col("lead.th").alias("th"))
    rows = _keyed(docs, id_col, text_col).select(known(F.col("lead.doc_id")).alias("k"), F.col("lead.th").alias("th"), "text")
    found = rows.join(F.broadcast(keys) if few else keys, ["k", "th"]).groupBy("node").agg(F.min("text").alias("text"))
    return found.select("node", shingle_set(F.col("text"), width).alias("s"))


def _prefix(n: Column) -> Column:
    return (n - F.expr("(4 * n + 4) div 5") + 1).cast("int")


def _cells(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(token, node, n, q): what the prefixes hold, q its place from 0, without shingles that no other set can meet.

    Sets whose low part holds too few light shingles, since they share a common passage, take their
    prefix from the whole set, so a common passage is in no prefix but of sets that consist of it.
    """
    low = nodes.select("node", "n", "p", F.size("low").alias("m"), F.posexplode("low").alias("i", "token"))
    shared = _kept(low.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    met = low.join(shared, "token").withColumn("heavy", F.col("df") > HEAVY)
    each = met.groupBy("node").agg(F.min("n").alias("n"), F.min("p").alias("p"), F.min("m").alias("m"), F.collect_list(F.when(F.col("heavy"), F.col("i"))).alias("hs"), F.collect_list(F.when(~F.col("heavy"), F.struct("i", "token"))).alias("ls"))
    each = _kept(each.withColumn("whole", F.col("m") - F.size("hs") < F.least("p", "n")))
    sweep(docs.sparkSession)
    # The place of a light shingle among the light ones is its own less the heavy ones before it.
    light = F.filter(F.transform("ls", lambda x: F.struct(x["token"].alias("token"), (x["i"] - F.size(F.filter("hs", lambda h: h < x["i"]))).alias("q"))), lambda x: x["q"] < F.col("p"))
    some = each.where(~F.col("whole")).select("node", "n", F.explode(light).alias("x")).select("x.token", "node", "n", "x.q")
    rest = nodes.join(each.where("whole").select("node"), "node", "left_semi").select("node", "n", "p", "lead")
    sets = _full(docs, rest, id_col, text_col, width).select("node", F.explode("s").alias("token"))
    heavy = shared.where(F.col("df") > HEAVY).select("token", F.lit(True).alias("h"))
    order = sets.join(heavy, "token", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("h", F.lit(False)).alias("h"), "token"))).alias("s"))
    first = order.join(rest.select("node", "n", "p"), "node").select("node", "n", F.posexplode(F.expr("slice(s, 1, p)")).alias("q", "x"))
    whole = _kept(first.select("x.token", "node", "n", "q"))
    # A shingle in one low part alone may still be met in a prefix that goes beyond its set's low part.
    lone = whole.select("token").distinct().join(shared.select("token"), "token", "left_anti")
    found = low.join(lone, "token", "left_semi").join(each.select("node", "hs", "whole"), "node", "left")
    place = F.col("i") - F.coalesce(F.size(F.filter("hs", lambda h: h < F.col("i"))), F.lit(0))
    late = found.where(~F.coalesce("whole", F.lit(False))).withColumn("q", place).where("q < p").select("token", "node", "n", "q")
    return some.unionByName(whole).unionByName(late)


def _bitmaps(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, bits): a struct of LONGS longs, in which each shingle of the whole set turns one bit over.

    Two bitmaps differ in no more bits than there are shingles in one of the two sets alone.
    """
    sets = _full(docs, nodes, id_col, text_col, width)
    turned = [F.expr(f"aggregate(filter(s, x -> pmod(x, {LONGS}) = {k}), 0L, (a, x) -> a ^ shiftleft(1L, cast(pmod(x div {LONGS}, 64) as int)))").alias(f"b{k}") for k in range(LONGS)]
    return sets.select("node", F.struct(*turned).alias("bits"))


def _apart() -> Column:
    """In how many bits the bitmaps ba and bb differ."""
    return sum((F.bit_count(F.col(f"ba.b{k}").bitwiseXOR(F.col(f"bb.b{k}"))) for k in range(LONGS)), F.lit(0))


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(u, v): which of the checkpointed pairs (a, b, na, nb) are near copies, by their low parts and then by their whole sets."""
    parts = nodes.select("node", F.expr("slice(low, 1, p)").alias("s"))
    few = pairs.count() <= SMALL  # then what follows is one partition, and nothing is dealt out
    gathered = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    pairs = gathered(pairs)
    own = gathered(_kept(_some(parts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))
    # Up to the lesser end of two low parts all is known; beyond it they share the rest of the smaller at most.
    held = pairs.join(own.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    end = F.least(F.element_at("sa", -1), F.element_at("sb", -1))
    beyond = [F.col(n) - F.size(F.filter(s, lambda x: x <= F.col("end"))) for n, s in (("na", "sa"), ("nb", "sb"))]
    held = held.withColumn("end", end).withColumn("most", F.size(F.array_intersect("sa", "sb")) + F.least(*beyond))
    pairs = _kept(held.where("9 * most >= 4 * (na + nb)").select("a", "b", "na", "nb"))
    held = own = None
    sweep(docs.sparkSession)
    pairs = gathered(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = gathered(_kept(_full(docs, _kept(_some(nodes.select("node", "lead"), ends)), id_col, text_col, width)))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def fingerprinted(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(u, v): near copies among the texts that SimHash puts together, each with one of its group.

    A group is connected by fingerprints that differ in two bits or fewer; its texts are compared with
    the one with the least lead. What differs from that one is left to the search by prefixes.
    """
    found = simhash.near_duplicates(docs, id_col, text_col)
    put = found.select(known(F.col("doc_id")).alias("k"), "th", "group").distinct()
    named = _kept(nodes.select("node", "n", "lead", known(F.col("lead.doc_id")).alias("k"), F.col("lead.th").alias("th")).join(put, ["k", "th"]).select("node", "n", "lead", "group"))
    first = named.groupBy("group").agg(F.min(F.struct("lead", "node", "n")).alias("r"), F.count("*").alias("m")).where("m > 1")
    first = _kept(first.select("group", "r"))
    pairs = named.join(F.broadcast(first) if first.count() <= FEW else first, "group").where("node <> r.node").select(F.col("node").alias("a"), F.col("r.node").alias("b"), F.col("n").alias("na"), F.col("r.n").alias("nb"))
    return _confirmed(docs, nodes, _kept(pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)")), id_col, text_col, width)


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, root) of all nodes that have a near copy.

    What SimHash puts together and is alike is connected first. In each bucket of a shingle, the
    member that shares most is compared with all others outside its component, and goes; what is connected by then needs no more comparing. When the pairs left are no
    more than the cells, or a round has not halved them, all are compared; in the second case within the
    join, by bitmaps of the whole sets: sets of na and nb shingles are near copies only if at most
    (na + nb) / 9 shingles are in one alone. So every pair of a bucket is compared or connected, and
    of a large group that does not connect few pairs but the near copies leave the join, though the join
    still looks at all.
    """
    cells = _kept(_cells(docs, nodes, id_col, text_col, width))
    total = cells.count()
    sized = cells.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    cells = _kept(cells.join(sized, "token"))
    score = cells.groupBy("node").agg((F.sum("m") / F.min("n")).alias("w"))
    cells = _kept(cells.drop("m").join(score, "node"))
    sweep(docs.sparkSession)
    edges = _kept(fingerprinted(docs, nodes, id_col, text_col, width))
    comp, before = components(edges), None
    while True:
        rooted = cells.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = _kept(rooted.select("token", "node", "n", "w", "q", "root"))
        open_ = rooted.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("w", "node", "n", "root", "q")).alias("r")).where("lo < hi")
        open_ = _kept(open_.select("token", "m", "r"))
        left = open_.agg(F.sum(F.expr("m * (m - 1) div 2"))).first()[0]
        if not left:
            return comp
        # At the first shingle that two sets share, the rest of the smaller is all they can share besides.
        near_size = "5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * least(na - qa, nb - qb) >= 4 * (na + nb)"
        last = left <= max(total, 10_000)
        slow = not last and before is not None and 2 * left > before
        before = left
        members = rooted.join(open_.select("token", "r"), "token")
        if slow:
            last = True
            ends = _kept(_some(nodes.select("node", "lead"), members.select("node").distinct()))
            members = _kept(members.join(_bitmaps(docs, ends, id_col, text_col, width), "node"))
            a = members.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("q").alias("qa"), F.col("root").alias("ra"), F.col("bits").alias("ba"))
            b = members.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("q").alias("qb"), F.col("root").alias("rb"), F.col("bits").alias("bb"))
            pairs = a.join(b, "token").where("a < b").where(9 * _apart() <= F.col("na") + F.col("nb"))
        elif last:
            a = members.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("q").alias("qa"), F.col("root").alias("ra"))
            b = members.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("q").alias("qb"), F.col("root").alias("rb"))
            pairs = a.join(b, "token").where("a < b")
        else:
            pairs = members.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("q").alias("qa"), F.col("root").alias("ra"), F.col("r.node").alias("b"), F.col("r.n").alias("nb"), F.col("r.q").alias("qb"), F.col("r.root").alias("rb"))
        pairs = _kept(pairs.where("ra <> rb").where(near_size).select("a", "b", "na", "nb").distinct())
        members = None
        found = _confirmed(docs, nodes, pairs, id_col, text_col, width)
        edges = _kept(edges.unionByName(found))
        comp = components(edges)
        sweep(docs.sparkSession)
        if last:
            return comp
        cells = rooted.join(open_.select("token", "r"), "token").where("node <> r.node").select("token", "node", "n", "w", "q")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs that stay: one of each group of near copies, the one with the least id, then text hash.

    Groups are connected by pairs with a similarity of 4/5 or more. Texts without words are copies of
    each other. Of rows that repeat one stays; a null id comes after all others. All columns of docs are
    returned.
    """
    made = _keyed(docs, id_col, text_col).select("lead", shingle_set(F.col("text"), width).alias("s")).select("lead", "s", F.size("s").cast("long").alias("n"))
    made = made.withColumn("p", _prefix(F.col("n"))).select(F.xxhash64("s").alias("node"), "lead", "n", "p", F.slice("s", F.lit(1), F.expr("cast(p + p div 4 + 1 as int)")).alias("low"))
    nodes = _kept(made.groupBy("node").agg(F.min("lead").alias("lead"), F.min("n").alias("n"), F.min("p").alias("p"), F.min("low").alias("low")))
    sweep(docs.sparkSession)
    comp = links(docs, nodes, id_col, text_col, width)
    least = nodes.select("node", "lead").join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("lead").alias("lead"))
    return one_of_each(docs, least.select(known(F.col("lead.doc_id")).alias("k"), F.col("lead.th").alias("h")), id_col, text_col)
