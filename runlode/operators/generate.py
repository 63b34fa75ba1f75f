"""Candidates and grids from the counter stream: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlode.functions.scalars import derive, draw, uniform_f32, unit_f64

MAX_CANDIDATES = 1_000_000
WEIGHTS = 1091


def candidates(spark: SparkSession, root_seed: int, count: int) -> DataFrame:
    """(i, nonce): one row a candidate; its nonce is the word derived for it."""
    if not 1 <= count <= MAX_CANDIDATES:
        raise ValueError(f"count must be from 1 to {MAX_CANDIDATES}")
    return spark.range(count).select(F.col("id").alias("i"), derive(F.lit(root_seed).cast("long"), F.col("id")).alias("nonce"))


def reaction_genomes(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with one uniform single-precision draw a range, counters from 0 in their order."""
    return rows.select("*", *[uniform_f32(F.col("nonce"), F.lit(k), low, high).alias(name) for k, (name, (low, high)) in enumerate(ranges.items())])


def network_genomes(rows: DataFrame, scale: float, weights: int = WEIGHTS) -> DataFrame:
    """Rows with ``weights`` draws in [-scale, scale]; weight j has counter j."""
    return rows.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(weights - 1)), lambda j: uniform_f32(F.col("nonce"), j, -scale, scale)))


def duplicate_genomes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second): the two least indexes of each genome that occurs twice; any row is an error."""
    first = rows.groupBy(*columns).agg(F.min("i").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, columns).where("i > first").groupBy(*columns, "first").agg(F.min("i").alias("second")).select("first", "second")


def ignition(seeds: DataFrame, width: int, height: int, background: list[float], patch: list[float], divisor: int, noise: float) -> DataFrame:
    """(i, x, y, c, v): the first grid of each row's nonce, in long form and single precision.

    A centred square of side max(1, min(width, height) div divisor) holds the patch values, each
    times 1 + (t - 1/2) noise for a draw t of its cell's stream; all else is the background.
    """
    side = max(1, min(width, height) // divisor)
    x0, y0 = (width - side) // 2, (height - side) // 2
    cells = seeds.select("i", "nonce", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("cell")).select("i", "nonce", (F.col("cell") % width).alias("x"), F.floor(F.col("cell") / width).cast("int").alias("y"))
    long = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(background) - 1))).alias("c"))
    inside = F.col("x").between(x0, x0 + side - 1) & F.col("y").between(y0, y0 + side - 1)
    t = unit_f64(draw(derive(F.col("nonce"), F.col("y").cast("long") * width + F.col("x")), F.col("c"))).cast("float")
    single = lambda x: F.lit(float(x)).cast("float")
    base = F.element_at(F.array(*map(single, patch)), F.col("c") + 1)
    bent = (single(1.0) + ((t - single(0.5)).cast("float") * single(noise)).cast("float")).cast("float")
    rest = F.element_at(F.array(*map(single, background)), F.col("c") + 1)
    return long.select("i", "x", "y", "c", F.when(inside, (base * bent).cast("float")).otherwise(rest).alias("v"))


def accumulate(acc: Column, step: Column, steps: int) -> Column:
    """The accumulator after ``steps`` folds by the absolute step index."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), acc, lambda a, j: derive(a, step + j.cast("long"))) if steps else acc


def stub_outcomes(tasks: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(i, attempts, outcome, acc): how each row (i, seed, behaviour, n) ends under the retry policy.

    succeed and sleep complete at once; flaky fails below attempt n and is retried while attempts
    remain, else the search fails; reject and panic are definitive; accumulate folds n steps.
    """
    flaky_ok = F.col("n") < max_attempts
    behaviour = F.col("behaviour")
    outcome = F.when(behaviour.isin("succeed", "sleep", "accumulate") | (behaviour == "flaky") & flaky_ok, "committed").when(behaviour == "flaky", "search_failed").otherwise("rejected")
    attempts = F.when((behaviour == "flaky") & flaky_ok, F.col("n") + 1).when(behaviour == "flaky", F.lit(max_attempts).cast("long")).otherwise(F.lit(1).cast("long"))
    folded = F.aggregate(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")), F.col("seed"), derive)
    return tasks.select("i", attempts.alias("attempts"), outcome.alias("outcome"), F.when(behaviour == "accumulate", folded).alias("acc"))
