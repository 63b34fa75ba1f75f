"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlode.llm.common import checkpointed, sweep


#: Up to so many edges of some 20 bytes, rounds run in one task and deal nothing out.
SMALL = 50_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node that can be reached.

    edges: two columns of one orderable type, null-free; repeated edges and loops are harmless. No
    edges give no rows. Each round is two aggregations and two joins on a node, so a hub is a skewed
    join that adaptive execution splits, and the edges only ever shrink towards one star for each
    component. The number of rounds grows with the logarithm of the longest path. Up to SMALL edges,
    all of them are one partition.
    """
    u, v = edges.columns
    now = checkpointed(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    state = _state(now)
    gathered = (lambda df: df.coalesce(1)) if state[0] <= SMALL else (lambda df: df)
    now = gathered(now)
    for k in range(max_rounds):
        if not state[0]:
            break
        if k % 2:  # a round leaves five shuffles behind
            both = least = large = low = hung = nxt = None
            sweep(now.sparkSession)
        both = gathered(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = gathered(checkpointed(gathered(hung.unionByName(low.select("u", F.col("m").alias("v")))).distinct()))
        after = _state(nxt)
        if after == state:
            break
        now, state = nxt, after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
