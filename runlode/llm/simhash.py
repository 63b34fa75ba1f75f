"""SimHash near-duplicates by covering locality-sensitive hashing, in DataFrame operations only.

A fingerprint has 64 bits. For radius r each bit position gets one of the 2^(r+1)-1 nonzero vectors
of r+1 bits, and each such vector v also names a table, whose mask keeps the positions with an odd
inner product with v. Any r positions leave a v orthogonal to all of them, so two fingerprints that
differ in at most r positions agree under that v's mask: every link collides in some table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed, fold_case, known, one_of_each, space_words
from runlode.llm.graph import components

BITS = 64
_LANES = 0x0000000100000001


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """The masks of the 2^(radius+1)-1 tables, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row (doc_id, th, fp long) for each row of docs; th is the text's own hash.

    Shingles are ``width`` case-folded words joined by a space, repeats included; a shorter text is
    one shingle, and a null or wordless text has fingerprint 0. A bit is set if it is set in over
    half of the shingles' XXH64 values. Each sum counts two bits in lanes of 32 bits, so 32 sums
    count all 64 and no text that fits a row can overflow one. Sums are taken before the shuffle;
    rows that repeat add up to the same majority and are dealt out again.
    """
    columns = [f"w{i}" for i in range(width)]

    def shingled(w: Column) -> Column:
        n = F.size(w)
        short = F.array(F.struct(*[(F.when(n > 0, F.concat_ws(" ", w)) if c == "w0" else F.lit(None).cast("string")).alias(c) for c in columns]))
        return F.when(n >= width, F.arrays_zip(*[F.slice(w, i + 1, n - (width - 1)).alias(c) for i, c in enumerate(columns)])).otherwise(short)

    # The words are named several times and computed once: as the variable of a function.
    words = space_words(fold_case(F.col(text_col)))
    made = F.transform(F.array(words), shingled)[0]
    shingles = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), made.alias("s"))
    each = shingles.select("doc_id", "th", F.posexplode("s").alias("i", "g")).select("doc_id", "th", "i", F.when(F.col("g.w0").isNotNull(), F.xxhash64(F.concat_ws(" ", *[F.col(f"g.{c}") for c in columns]))).alias("h"))
    sums = each.groupBy("doc_id", "th").agg(F.count("h").alias("n"), F.count(F.when(F.col("i") == 0, 1)).alias("copies"), *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(32)])
    fp = F.lit(0).cast("long")
    for j in range(32):
        s = F.coalesce(F.col(f"s{j}"), F.lit(0).cast("long"))
        for bit, count in ((j, s.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(s, 32))):
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return sums.select("doc_id", "th", "copies", fp.alias("fp")).select("doc_id", "th", "fp", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_")).select("doc_id", "th", "fp")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): pairs that connect what lies within ``radius`` bits, for distinct fingerprints ``fp``.

    Rows that share a bucket of a covering table are candidates, and the bits outside the masks of
    the tables where they met are the only ones in which they can differ from a partner. Links are
    then confirmed without forming the pairs of a bucket: for radius 2, each candidate names itself
    and its variants with one such bit flipped; all that name one value are within two bits of each
    other, and two within two bits name a common value. A value has at most 65 namers, whatever the
    size of a bucket. Only radius 1 and 2 have this exact confirmation.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(a))).alias("key"), F.lit(_signed(~a & (1 << BITS) - 1)).alias("free")) for k, a in enumerate(covering_masks(radius))]))
    cells = distinct.select("fp", tables.alias("c")).select("fp", "c.*")
    shared = cells.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key")
    met = cells.join(shared, ["k", "key"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    flip = F.filter(flips, lambda x: x.bitwiseAND(F.col("free")) == x)
    if radius == 1:  # both sides name the value with the bit cleared
        flip = F.filter(flip, lambda x: (x == 0) | (x.bitwiseAND(F.col("fp")) == x))
    named = met.select("fp", F.explode(flip).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    groups = named.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 1:  # namers of one value may differ by two bits; each is one bit from the value if that exists
        groups = groups.where(F.array_contains("fps", F.col("z")))
        return groups.select(F.explode("fps").alias("u"), F.col("z").alias("v")).where("u <> v")
    return groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, th, fp, group, component_id) for each row.

    group names the component by a fingerprint; component_id is the least doc_id reachable by links,
    itself included. Null ids are kept and never win against another id of their component; an empty
    table gives no rows. Equal fingerprints are one node, so copies cost nothing beyond their own
    rows.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, width))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = components(links(nodes.select("fp"), radius))
    linked = nodes.join(comp, nodes["fp"] == comp["node"]).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = linked.join(roots, "root").select("fp", "root", "component_id")
    named = checkpointed(nodes.join(grouped, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id")))
    # A fingerprint with a thousandth of all rows or more is joined by broadcast: there are a thousand
    # of them at most, and their copies stay where they are. The rest meet in a shuffle.
    total = named.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(named.where(F.col("n") * 1000 >= total).drop("n"))
    rare = named.where(F.col("n") * 1000 < total).drop("n")
    rows = fps.join(common, "fp").unionByName(fps.join(common.select("fp"), "fp", "left_anti").join(rare, "fp"))
    return rows.select("doc_id", "th", "fp", "group", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay: one of each group, the one with the least id, then text hash.

    Of rows that repeat one stays; a null id comes after all others. All columns of docs are returned.
    """
    found = near_duplicates(docs, id_col, text_col, width, radius)
    least = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("r"))
    return one_of_each(docs, least.select(known(F.col("r.doc_id")).alias("k"), F.col("r.th").alias("h")), id_col, text_col)


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
