"""The whole configuration file: search, execution, machines, fleet, budget and domains, read strictly.

``config.load`` reads the three sections that a query needs; this one reads all that a run needs.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from runlode.operators.ledger import Constraints

# Fixed: the keys that each section admits.
SEARCH = {"root_seed", "format", "segments", "generator", "params"}
CONFIG = {"store", "max_attempts", "attempt_timeout_ms", "answer_timeout_ms", "checkpoint_interval_ms", "checkpoint_interval_steps"}
ORCHESTRATOR = {"migrate", "image", "runtime", "run_args", "workers", "device"}
MACHINE = {"ssh", "count", "image", "env", "runtime", "run_args", "workers", "device", "provider", "fill", "disk_gb", "ready_timeout_ms", "ready_poll_ms", "constraints", "root", "binary"}
CONSTRAINTS = {"gpu_models", "min_gpu_count", "min_vram_mb", "min_cuda", "max_price_usd_hour", "min_reliability", "verified_only", "min_disk_gb", "min_bandwidth_mbps"}
BUDGET = {"max_spend_usd", "max_wall_clock_ms"}
DOMAIN = {"binary", "env", "payload", "install", "payload_digest", "sdk"}
TOP = {"search", "config", "orchestrator", "host", "host_class", "fleet", "budget", "domain"}


@dataclass(frozen=True)
class Device:
    select: str
    workers: int


@dataclass(frozen=True)
class Machine:
    """A host or a class of hosts: addresses, or a provider to rent from."""

    name: str
    addresses: tuple[str, ...] = ()
    count: int = 1
    workers: int | None = None
    devices: tuple[Device, ...] = ()
    provider: str | None = None
    image: str | None = None
    runtime: str = "docker"
    run_args: tuple[str, ...] = ()
    env: tuple[tuple[str, str], ...] = ()
    disk_gb: int = 32
    ready_timeout_ms: int = 1_200_000
    ready_poll_ms: int = 5_000
    constraints: Constraints = Constraints()


@dataclass(frozen=True)
class Loaded:
    root_seed: int
    format: str
    segments: int | None
    generator: dict
    params: dict
    store: str
    max_attempts: int = 3
    attempt_timeout_ms: int | None = None
    answer_timeout_ms: int | None = None
    checkpoint_interval_ms: int | None = None
    checkpoint_interval_steps: int | None = None
    workers: int | None = None
    devices: tuple[Device, ...] = ()
    migrate: str | None = None
    hosts: dict[str, Machine] = field(default_factory=dict)
    classes: dict[str, Machine] = field(default_factory=dict)
    fleet: tuple[str, ...] = ()
    max_spend_micro: int | None = None
    max_wall_clock_ms: int | None = None
    domains: dict[str, dict] = field(default_factory=dict)


def _only(table: dict, allowed: set[str], where: str) -> dict:
    if unknown := set(table) - allowed:
        raise ValueError(f"{where}: unknown {', '.join(sorted(unknown))}")
    return table


def _need(table: dict, key: str, where: str):
    if key not in table:
        raise ValueError(f"{where}: missing {key}")
    return table[key]


def _positive(table: dict, key: str, where: str) -> int | None:
    """A bound; 0 and an absent key mean that there is none."""
    value = table.get(key)
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ValueError(f"{where}: {key} is not a whole number")
    return value or None


def _devices(table: dict, where: str) -> tuple[Device, ...]:
    found = []
    for d in table.get("device", []):
        _only(d, {"select", "workers"}, f"{where}.device")
        found.append(Device(_need(d, "select", f"{where}.device"), _need(d, "workers", f"{where}.device")))
        if found[-1].workers < 1:
            raise ValueError(f"{where}.device: workers must be at least 1")
    if found and "workers" in table:
        raise ValueError(f"{where}: workers and devices exclude each other")
    if table.get("workers", 1) < 1:
        raise ValueError(f"{where}: workers must be at least 1")
    return tuple(found)


def _micro(dollars: float, where: str) -> int:
    if not 0 <= dollars < float("inf"):
        raise ValueError(f"{where} is not an amount")
    return round(dollars * 1_000_000)


def _constraints(table: dict, where: str) -> Constraints:
    _only(table, CONSTRAINTS, where)
    price = table.get("max_price_usd_hour")
    return Constraints(
        gpu_models=tuple(table.get("gpu_models", ())),
        verified_only=table.get("verified_only", False),
        max_price=None if price is None else _micro(price, f"{where}.max_price_usd_hour"),
        **{k: table.get(k) for k in ("min_gpu_count", "min_vram_mb", "min_cuda", "min_disk_gb", "min_bandwidth_mbps", "min_reliability")},
    )


def _machine(name: str, table: dict, group: bool) -> Machine:
    where = f"{'host_class' if group else 'host'}.{name}"
    _only(table, MACHINE, where)
    ssh, count, provider = table.get("ssh"), table.get("count"), table.get("provider")
    if not group and (count is not None or isinstance(ssh, list)):
        raise ValueError(f"{where}: a host is one machine")
    if provider is not None and ssh is not None:
        raise ValueError(f"{where}: a rented machine has no address yet")
    if provider is None and ("constraints" in table or "disk_gb" in table):
        raise ValueError(f"{where}: only a rented machine has constraints")
    if table.get("runtime", "docker") not in ("docker", "podman"):
        raise ValueError(f"{where}: runtime is docker or podman")
    if count is not None and count < 1:
        raise ValueError(f"{where}: count must be at least 1")
    if group and ssh is not None and count is not None:
        raise ValueError(f"{where}: the addresses are the count")
    own = () if provider else tuple(ssh) if isinstance(ssh, list) else (ssh,) if ssh else tuple(f"{name}{k + 1}" for k in range(count or 1)) if group else (name,)
    if group and not provider and not own:
        raise ValueError(f"{where}: a class has members")
    return Machine(
        name, own, len(own) or count or 1, table.get("workers"), _devices(table, where), provider, table.get("image"), table.get("runtime", "docker"), tuple(table.get("run_args", ())), tuple(sorted(table.get("env", {}).items())),
        table.get("disk_gb", 32), table.get("ready_timeout_ms", 1_200_000), table.get("ready_poll_ms", 5_000), _constraints(table.get("constraints", {}), f"{where}.constraints"),
    )


def load(text: str) -> Loaded:
    """The configuration, or ValueError naming the section and key that is wrong."""
    top = _only(tomllib.loads(text), TOP, "the file")
    search, config = _only(_need(top, "search", "the file"), SEARCH, "search"), _only(_need(top, "config", "the file"), CONFIG, "config")
    generator = _need(search, "generator", "search")
    _need(generator, "id", "search.generator")
    if not 0 <= (seed := _need(search, "root_seed", "search")) < 1 << 63:
        raise ValueError("search: root_seed is not a number from 0 up")
    if (segments := search.get("segments")) is not None and segments < 1:
        raise ValueError("search: segments must be at least 1")
    if (attempts := config.get("max_attempts", 3)) < 1:
        raise ValueError("config: max_attempts must be at least 1")
    if config.get("checkpoint_interval_steps", 1) < 1:
        raise ValueError("config: checkpoint_interval_steps must be at least 1")
    runs = _only(top.get("orchestrator", {}), ORCHESTRATOR, "orchestrator")
    if "image" not in runs and ("runtime" in runs or "run_args" in runs):
        raise ValueError("orchestrator: runtime and run_args need an image")
    hosts = {k: _machine(k, v, False) for k, v in top.get("host", {}).items()}
    classes = {k: _machine(k, v, True) for k, v in top.get("host_class", {}).items()}
    if both := set(hosts) & set(classes):
        raise ValueError(f"{', '.join(sorted(both))}: both a host and a class")
    fleet = tuple(_only(top.get("fleet", {}), {"members"}, "fleet").get("members", ()))
    seen: set[str] = set()
    for member in fleet:
        if member not in hosts and member not in classes:
            raise ValueError(f"fleet: {member} is no host and no class")
        for address in (hosts.get(member) or classes[member]).addresses:
            if address in seen:
                raise ValueError(f"fleet: {address} is in the fleet twice")
            seen.add(address)
    if (to := runs.get("migrate")) is not None and to not in hosts:
        raise ValueError(f"orchestrator: migrate names {to}, which is no host")
    budget = _only(top.get("budget", {}), BUDGET, "budget")
    spend = budget.get("max_spend_usd")
    domains = {}
    for name, table in top.get("domain", {}).items():
        _need(_only(table, DOMAIN, f"domain.{name}"), "binary", f"domain.{name}")
        domains[name] = table
    return Loaded(
        seed, _need(search, "format", "search"), segments, generator, search.get("params", {}), config.get("store", "./store"), attempts,
        *(_positive(config, k, "config") for k in ("attempt_timeout_ms", "answer_timeout_ms", "checkpoint_interval_ms", "checkpoint_interval_steps")),
        runs.get("workers"), _devices(runs, "orchestrator"), to, hosts, classes, fleet, None if spend is None else _micro(spend, "budget.max_spend_usd"), _positive(budget, "max_wall_clock_ms", "budget"), domains,
    )
