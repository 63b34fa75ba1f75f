"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

The mix is a line of training time from 0 to 1. Each source demands words at a rate that changes
linearly over that time; the integral of the rate over all time is the source's target. A source's
documents, in the order of a digest of their ids and repeated as often as the target asks, meet that
demand one after another: where the demand that has built up equals the words handed out so far, the
next document is placed, once for each round. That inverts a quadratic. The whole mix is then sorted
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed

WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, source_size): one small row a source.

    Sources in code-point order, null last, weigh 1, 2, 3 and again; they share all words, and no
    target exceeds ``cap`` times its source. With the sources ordered by the level at which they
    fill, the level that uses up all words follows from running sums: each source below its own
    filling level gets its cap, the others share the rest by weight. The slopes of the demand are
    +1/2, 0 and -1/2 of the mean rate in turn. No rows give no rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", (F.col("k") % 3 + 1).cast("double")).withColumn("slope", F.element_at(F.array(F.lit(0.5), F.lit(0.0), F.lit(-0.5)), (F.floor(F.col("k") / 3) % 3 + 1).cast("int")))
    fill = Window.orderBy("level", "k")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    open_ = leveled.withColumn("share", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The least level that a share does not exceed: all sources before it are full, none from it on is.
    fits = F.when(F.col("share") <= F.col("level"), F.struct("level", "k"))
    level = open_.withColumn("cut", F.min_by("share", fits).over(everything))
    return level.select("source", "source_size", "weight", "slope", F.least(F.col("most"), F.coalesce(F.col("cut") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, pieces: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target, taken, position, positions, and ``keep``.

    taken: words of this document that the mix takes, repeats counted. All documents of a source are
    taken equally often but for the last round, which goes down the order until the target is met
    and takes of its last document the words still missing, so a source's taken words are its target
    rounded down. positions: training time in [0, 1) of the document's first word in each round that
    takes of it, empty if none does; position: the first of them, or null. Null texts and texts without words have size 0 and are never taken; null
    sources are one source; rows that repeat are separate rows and follow each other.

    Order in a source: md5 of the id, then of the text. Sums run in two levels, over ``pieces``
    ranges of the digest and within each, so that a source with a third of all rows is dealt over
    as many tasks as a third of all pieces; the sums of the pieces are the only rows that a source's
    window gathers.
    """
    if not 1 <= pieces <= 4096:
        raise ValueError("pieces must be from 1 to 4096")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("o"), F.xxhash64(text_col).alias("th"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = rows.withColumn("piece", (F.conv(F.substring("o", 1, 3), 16, 10).cast("int") * pieces / 4096).cast("int"))
    rows = checkpointed(rows)  # the texts are read once
    by_piece = rows.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    by_source = by_piece.groupBy("source").agg(F.sum("piece_size").alias("source_size"))
    goals = targets(by_source, cap)
    up_to = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_piece.select("source", "piece", F.coalesce(F.sum("piece_size").over(up_to), F.lit(0).cast("long")).alias("start"))
    plan = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("s"), starts["piece"].alias("p"), "start", "source_size", "slope", "target")
    inside = Window.partitionBy("source", "piece").orderBy("o", "doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["s"]) & (placed["piece"] == plan["p"])).withColumn("offset", F.col("start") + F.col("inner"))
    whole = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long"))
    last = whole - rounds * F.col("source_size")
    taken = F.col("size") * rounds + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), last - F.col("offset")))
    times = F.when(F.col("taken") > 0, (rounds + F.when(last > F.col("offset"), 1).otherwise(0)).cast("int")).otherwise(0)
    at = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1), F.lit(1), times), lambda r: inverse_demand((r * F.col("source_size") + F.col("offset")) / F.col("target"), F.col("slope")))
    return joined.withColumn("taken", taken).withColumn("positions", at).select("doc_id", "source", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions", *[F.col(f"kept_{c}").alias(c) for c in keep])


def inverse_demand(share: Column, slope: Column) -> Column:
    """The time t at which a demand of rate 1 + slope * (2t - 1) has built up to ``share``.

    The built-up demand is (1 - slope) t + slope t^2; the root is written so that a slope of 0 needs
    no case of its own.
    """
    b = F.lit(1.0) - slope
    return F.lit(2.0) * share / (b + F.sqrt(b * b + F.lit(4.0) * slope * share))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each round that takes of a document, range-sorted by its own position, with the round
    from 0 and the words it takes as ``taken``; documents that are not taken go.
    """
    columns = [c for c in mixed.columns if c not in ("taken", "position", "positions")]
    each = mixed.select("*", F.posexplode("positions").alias("round", "_at"))
    words = F.when(F.col("round") < F.size("positions") - 1, F.col("size")).otherwise(F.col("taken") - F.col("size") * F.col("round"))
    return each.select(*columns, "round", words.alias("taken"), F.col("_at").alias("position")).orderBy("position", "source", "doc_id")
