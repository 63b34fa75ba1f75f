"""Domains: what a search's format binds, as a generator (a table function) and an executor (a UDF).

An executor is a pure function of its input and returns its outcome as data: completed, failed (may be
retried) or rejected (final). An error that it raises is a rejection too, with the error as the
reason, except for ``Fault``, which ends the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlode.lineage import checkpointed

OUTCOME = "outcome string, artifacts array<struct<name:string,bytes:binary>>, stats array<struct<name:string,value:double>>, reason string"


class Fault(Exception):
    """The machinery, not the candidate, is broken."""


@dataclass(frozen=True)
class Completed:
    artifacts: dict[str, bytes]
    stats: dict[str, float]


@dataclass(frozen=True)
class Failed:
    reason: str


@dataclass(frozen=True)
class Rejected:
    reason: str


@dataclass(frozen=True)
class Domain:
    """execute(spec, params, seed, attempt, input_state) -> outcome; generate(root_seed, params) -> specs."""

    name: str
    environment: dict[str, str]
    execute: Callable[[bytes, bytes, int, int, bytes | None], Completed | Failed | Rejected]
    generate: Callable[[int, bytes], Iterable[bytes]]


REGISTRY: dict[str, Domain] = {}


def register(domain: Domain) -> None:
    if domain.name in REGISTRY:
        raise ValueError(f"{domain.name} is bound already")
    REGISTRY[domain.name] = domain


def _row(got: Completed | Failed | Rejected) -> dict:
    if isinstance(got, Completed):
        return {"outcome": "completed", "artifacts": [{"name": k, "bytes": v} for k, v in sorted(got.artifacts.items())], "stats": [{"name": k, "value": float(v)} for k, v in got.stats.items()], "reason": None}
    return {"outcome": "failed" if isinstance(got, Failed) else "rejected", "artifacts": [], "stats": [], "reason": got.reason}


def executor(name: str) -> Callable[..., Column]:
    """A column function of (spec, params, seed, attempt, input_state) that gives OUTCOME."""
    run = REGISTRY[name].execute

    @F.pandas_udf(OUTCOME)
    def execute(spec: pd.Series, params: pd.Series, seed: pd.Series, attempt: pd.Series, state: pd.Series) -> pd.DataFrame:
        out = []
        for s, p, x, a, i in zip(spec, params, seed, attempt, state, strict=True):
            try:
                out.append(_row(run(bytes(s), bytes(p), int(x), int(a), None if i is None else bytes(i))))
            except Fault:
                raise
            except Exception as e:
                out.append(_row(Rejected(f"panic: {e}")))
        return pd.DataFrame(out, columns=["outcome", "artifacts", "stats", "reason"])

    return execute


def generated(spark: SparkSession, name: str, root_seed: int, params: bytes) -> DataFrame:
    """(i, spec) in the generator's order, from a table function."""
    make = REGISTRY[name].generate

    @F.udtf(returnType="i long, spec binary")
    class Generate:
        def eval(self, seed: int, data: bytes):
            for i, spec in enumerate(make(seed, bytes(data))):
                yield i, spec

    return Generate(F.lit(root_seed), F.lit(params))


def evaluate(tasks: DataFrame, name: str, max_attempts: int = 3) -> DataFrame:
    """Tasks (i, spec, params, seed, input_state) with their final outcome and attempts.

    Failed attempts are tried again while attempts remain; each round runs only what failed, once,
    since its outcomes are written before they are read.
    """
    run = executor(name)
    left, done = tasks, None
    for attempt in range(max_attempts):
        tried = checkpointed(left.withColumn("_r", run("spec", "params", "seed", F.lit(attempt), "input_state")))
        final = tried if attempt + 1 == max_attempts else tried.where("_r.outcome <> 'failed'")
        rows = final.select("i", F.lit(attempt + 1).alias("attempts"), "_r.*")
        done = rows if done is None else done.unionByName(rows)
        left = tried.where("_r.outcome = 'failed'").drop("_r")
    return done
