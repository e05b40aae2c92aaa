"""Configuration: environment values with silent defaults, durations, TTL rules, shard identity and addresses."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import TypeVar

V = TypeVar("V")
UNITS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def env_value(env: Mapping[str, str], name: str, default: V, parse: Callable[[str], V]) -> V:
    """The parsed value; the default where it is unset or can't be parsed."""
    try:
        return parse(env[name])
    except (KeyError, ValueError):
        return default


def parse_duration(text: str) -> int | None:
    """Seconds of ``7d``, ``12h``, ``5m``, ``30s`` or a bare number; None if malformed."""
    text = text.strip()
    digits, unit = (text[:-1], UNITS[text[-1]]) if text and text[-1] in UNITS else (text, 1)
    return int(digits) * unit if digits.isascii() and digits.isdigit() else None


def parse_ttl_rules(text: str) -> list[tuple[str, int]]:
    """``prefix:duration`` pairs in their order; malformed parts are dropped, an empty prefix matches all keys."""
    rules = []
    for part in text.split(","):
        prefix, colon, duration = part.strip().partition(":")
        if colon and (seconds := parse_duration(duration)) is not None:
            rules.append((prefix.strip(), seconds))
    return rules


def pod_shard(pod_name: str) -> int:
    """The number after the last hyphen, else 0."""
    tail = pod_name.rpartition("-")[2]
    return int(tail) if tail.isascii() and tail.isdigit() else 0


def shard_address(shard: int, service: str, port: int, namespace: str = "default") -> str:
    return f"{service}-{shard}.{service}.{namespace}.svc.cluster.local:{port}"


def to_bool(text: str) -> bool:
    if text not in ("true", "false"):
        raise ValueError(text)
    return text == "true"


@dataclass(frozen=True)
class StoreConfig:
    """Defaults are those of the service; every one can be set from the environment."""

    memory_bytes: int = 256 << 20
    memory_entries: int | None = 100_000
    data_dir: str = "./data"
    disk_bytes: int = 50 << 30
    migration_age_secs: int = 24 * 3600
    object_prefix: str = "data/"
    migration_batch: int = 100
    migration_threshold: float = 80.0
    cache_only: bool = False
    ttl_rules: list[tuple[str, int]] = field(default_factory=list)
    total_shards: int = 1
    shard_id: int = 0
    virtual_nodes: int = 150

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> StoreConfig:
        d = cls()
        return cls(
            memory_bytes=env_value(env, "MEMORY_MAX_SIZE_MB", d.memory_bytes >> 20, int) << 20,
            memory_entries=env_value(env, "MEMORY_MAX_ENTRIES", d.memory_entries, int),
            data_dir=env.get("DATA_DIR", d.data_dir),
            disk_bytes=env_value(env, "DISK_MAX_SIZE_GB", d.disk_bytes >> 30, int) << 30,
            migration_age_secs=env_value(env, "DISK_MIGRATION_AGE_HOURS", d.migration_age_secs // 3600, int) * 3600,
            object_prefix=env.get("S3_PREFIX", d.object_prefix),
            migration_batch=env_value(env, "MIGRATION_BATCH_SIZE", d.migration_batch, int),
            migration_threshold=env_value(env, "MIGRATION_THRESHOLD_PERCENT", d.migration_threshold, float),
            cache_only=env_value(env, "CACHE_ONLY", d.cache_only, to_bool),
            ttl_rules=parse_ttl_rules(env.get("TTL_RULES", "")),
            total_shards=env_value(env, "TOTAL_SHARDS", d.total_shards, int),
            shard_id=env_value(env, "SHARD_ID", pod_shard(env.get("POD_NAME", "")), int),
            virtual_nodes=env_value(env, "VIRTUAL_NODES", d.virtual_nodes, int),
        )


def proxy_addresses(env: Mapping[str, str] = os.environ) -> list[str]:
    """Shard addresses of a router: the given list wins, else they follow from the service's name."""
    if given := [x.strip() for x in env.get("SHARD_ADDRESSES", "").split(",") if x.strip()]:
        return given
    service, port = env.get("SHARD_SERVICE_NAME", "stratakv"), env_value(env, "SHARD_PORT", 8080, int)
    return [shard_address(k, service, port, env.get("POD_NAMESPACE", "default")) for k in range(env_value(env, "TOTAL_SHARDS", 1, int))]
