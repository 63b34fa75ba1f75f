"""Grids: reduction to scalars, the snapshot test, and cellular rules in single precision.

A grid is cell-major: channel c of cell (x, y) is at (y * width + x) * channels + c.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlode.functions.scalars import finite

MAX_CHANNELS = 16
_M = (1 << 64) - 1


def scalar_names(channels: int) -> list[str]:
    return [f"c{c}.{m}" for c in range(channels) for m in ("mean", "var", "min", "max")] + ["population", "activity"]


def grid_reduce(grids: DataFrame, channels: int, alive_channel: int, alive_min: float, key: str = "cand") -> DataFrame:
    """(key, stats): named scalars of rows (key, current, previous), in the order of scalar_names.

    Mean and two-pass population variance, least and greatest value of each channel; the share of
    cells whose alive channel reaches the minimum; the mean absolute change of a value. Computed in
    the row, so nothing is shuffled.
    """
    if not 1 <= channels <= MAX_CHANNELS or not 0 <= alive_channel < channels:
        raise ValueError("channels or alive channel out of range")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v.cast("double"))
    size = F.size("current")
    made: list[Column] = []
    for c in range(channels):
        own = _channel(F.col("current"), channels, c)
        mean = total(own) / F.size(own)
        made += [mean, _variance(own, mean), F.array_min(own).cast("double"), F.array_max(own).cast("double")]
    alive = _channel(F.col("current"), channels, alive_channel)
    made.append(F.size(F.filter(alive, lambda v: ~F.isnan(v) & (v >= alive_min))) / F.size(alive))
    made.append(total(F.zip_with("current", "previous", lambda a, b: F.abs(a.cast("double") - b.cast("double")))) / size)
    stats = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in zip(scalar_names(channels), made, strict=True)])
    return grids.select(key, stats.alias("stats"))


def _channel(grid: Column, channels: int, c: int) -> Column:
    return F.transform(F.sequence(F.lit(c + 1), F.size(grid), F.lit(channels)), lambda i: F.element_at(grid, i))


def _variance(values: Column, mean: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, v: x + (v.cast("double") - mean) * (v.cast("double") - mean)) / F.size(values)


def keep_snapshot(reduced: DataFrame, scalar: str | None, least: float | None) -> DataFrame:
    """Rows with ``keep``: all scalars finite and the named one at least the minimum; no test keeps all."""
    if scalar is None:
        return reduced.withColumn("keep", F.lit(True))
    named = F.filter("stats", lambda s: s["name"] == scalar)
    known = F.assert_true(F.size(named) == 1, F.lit(f"no scalar {scalar}"))
    test = F.forall("stats", lambda s: finite(s["value"])) & (named[0]["value"] >= F.lit(float(least)))
    return reduced.withColumn("keep", F.when(known.isNull(), F.coalesce(test, F.lit(False))))


def _rolled(g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, right, upper and lower neighbours of (h, w, channels), around the edges."""
    return np.roll(g, 1, 1), np.roll(g, -1, 1), np.roll(g, 1, 0), np.roll(g, -1, 0)


def smoke_max(g: np.ndarray) -> np.ndarray:
    return np.maximum.reduce([g, *_rolled(g)])


def reaction_step(g: np.ndarray, feed: float, kill: float, du: float, dv: float, dt: float) -> np.ndarray:
    """One step of two reacting and diffusing channels, without clamping."""
    f, k, du, dv, dt = (np.float32(x) for x in (feed, kill, du, dv, dt))
    left, right, up, down = _rolled(g)
    lap = left + right + up + down - np.float32(4) * g
    u, v = g[..., 0], g[..., 1]
    uvv = u * v * v
    return np.stack([u + dt * (du * lap[..., 0] - uvv + f * (np.float32(1) - u)), v + dt * (dv * lap[..., 1] + uvv - (f + k) * v)], axis=-1)


def _words(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def network_step(g: np.ndarray, weights: np.ndarray, dt: float, seed: int, step: int) -> np.ndarray:
    """One step of the neural rule: 3 filters of 3 x 3, 24 to 32 to 8, where a cell's draw fires."""
    perception, w1, b1, w2, b2 = np.split(np.asarray(weights, np.float32), np.cumsum([27, 768, 32, 256]))
    h, w, c = g.shape
    taps = np.stack([np.roll(g, (1 - dy, 1 - dx), (0, 1)) for dy in range(3) for dx in range(3)])
    seen = np.einsum("pt,tyxc->yxcp", perception.reshape(3, 9), taps).reshape(h, w, c * 3)
    hidden = np.maximum(seen @ w1.reshape(24, 32) + b1, np.float32(0))
    delta = hidden @ w2.reshape(32, 8) + b2
    with np.errstate(over="ignore"):
        cells = np.arange(h * w, dtype=np.uint64)
        stream = _words(np.uint64(seed & _M) ^ _words(cells))
        masks = _words(stream ^ _words(np.array([1], np.uint64)))
        drawn = _words(masks + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & _M))
    fires = (drawn >> np.uint64(63) == 0).reshape(h, w, 1).astype(np.float32)
    return (g + fires * np.float32(dt) * delta).astype(np.float32)


def run_reaction(rows: DataFrame, width: int, height: int, steps: int, dt: float = 1.0, key: str = "i") -> DataFrame:
    """(key, current, previous) of rows (key, grid, feed, kill, du, dv) after ``steps`` steps.

    All steps of a candidate run inside one batch call; with no step both grids are the first one.
    Rows are independent, so they stay where they are.
    """

    def step(row, g: np.ndarray) -> np.ndarray:
        return reaction_step(g, row.feed, row.kill, row.du, row.dv, dt)

    return _run(rows, step, width, height, 2, steps, key)


def run_smoke(rows: DataFrame, width: int, height: int, channels: int, steps: int, key: str = "i") -> DataFrame:
    return _run(rows, lambda _, g: smoke_max(g), width, height, channels, steps, key)


def run_network(rows: DataFrame, width: int, height: int, steps: int, dt: float = 1.0, key: str = "i") -> DataFrame:
    """As run_reaction for rows (key, grid, weights, nonce, start): start is the absolute first step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _advanced(batch, key, lambda r, g, k: network_step(g, r.weights, dt, int(r.nonce), int(r.start) + k), (height, width, 8), steps)

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, current array<float>, previous array<float>")


def _run(rows: DataFrame, step, width: int, height: int, channels: int, steps: int, key: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _advanced(batch, key, lambda r, g, _: step(r, g), (height, width, channels), steps)

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, current array<float>, previous array<float>")


def _advanced(batch: pd.DataFrame, key: str, step, shape: tuple[int, int, int], steps: int) -> pd.DataFrame:
    now, old = [], []
    for r in batch.itertuples():
        g = p = np.asarray(r.grid, np.float32).reshape(shape)
        for k in range(steps):
            p, g = g, step(r, g, k).astype(np.float32)
        now.append(g.ravel())
        old.append(p.ravel())
    return pd.DataFrame({key: batch[key], "current": now, "previous": old})
