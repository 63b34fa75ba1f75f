"""A search's configuration in TOML, read strictly: unknown and missing keys are errors."""

from __future__ import annotations

import re
import tomllib
from dataclasses import MISSING, dataclass, field, fields

NAME = re.compile(r"[a-z0-9._-]{1,64}")


@dataclass(frozen=True)
class Search:
    root_seed: int
    format: str
    generator: str
    segments: int | None = None
    generator_params: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.root_seed < 1 << 64:
            raise ValueError("root_seed is not a 64-bit number")
        if self.segments is not None and self.segments < 1:
            raise ValueError("segments must be at least 1")
        for name in (self.format, self.generator):
            if not NAME.fullmatch(name):
                raise ValueError(f"{name!r} is not a name")
        if snapshot := self.params.get("snapshot_when"):
            if self.segments is not None:
                raise ValueError("snapshot_when is for unsegmented searches")
            if set(snapshot) != {"scalar", "min"}:
                raise ValueError("snapshot_when has the keys scalar and min")


@dataclass(frozen=True)
class Budget:
    max_spend_usd: float | None = None
    max_hours: float | None = None


@dataclass(frozen=True)
class Member:
    destination: str
    count: int = 1


@dataclass(frozen=True)
class Config:
    search: Search
    budget: Budget = Budget()
    fleet: tuple[Member, ...] = ()

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for m in self.fleet:
            if m.count < 1:
                raise ValueError("a fleet member counts at least 1")
            if m.destination in seen:
                raise ValueError(f"{m.destination} is in the fleet twice")
            seen.add(m.destination)


def _strict(kind: type, table: dict, where: str):
    names = {f.name for f in fields(kind)}
    if unknown := set(table) - names:
        raise ValueError(f"{where}: unknown {', '.join(sorted(unknown))}")
    needed = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING}
    if missing := needed - set(table):
        raise ValueError(f"{where}: missing {', '.join(sorted(missing))}")
    return kind(**table)


def load(text: str) -> Config:
    top = tomllib.loads(text)
    if unknown := set(top) - {"search", "budget", "fleet"}:
        raise ValueError(f"unknown {', '.join(sorted(unknown))}")
    if "search" not in top:
        raise ValueError("missing search")
    return Config(_strict(Search, top["search"], "search"), _strict(Budget, top.get("budget", {}), "budget"), tuple(_strict(Member, m, "fleet") for m in top.get("fleet", [])))
