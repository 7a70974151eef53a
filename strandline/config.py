"""Settings, from a file of KEY=VALUE lines and the environment, which wins."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from .sources.tables import Files


@dataclass(frozen=True)
class Config:
    """The defaults."""

    root: str = "./data"
    parallelism: int = 6
    chunk_size: int = 50_000
    pretty_json: bool = False
    balance_shards: bool = True
    density_probes: int | None = None
    auto_incremental: bool = True
    exact_archive_dedup: bool = True
    archive_dedup_parts: int = 3
    archive_dedup_max_ids: int = 2_000_000
    watch_interval_ms: int = 15 * 60_000
    live_flush_interval_ms: int = 2000
    live_batch_messages: int = 200
    live_max_buffer: int = 10_000
    log_level: str = "info"

    def archive_options(self) -> dict:
        """What Archive takes; exact deduplication has no bound."""
        return {"chunk": self.chunk_size, "dedup_mode": "exact" if self.exact_archive_dedup else "windowed", "dedup_parts": self.archive_dedup_parts, "dedup_ids": None if self.exact_archive_dedup else self.archive_dedup_max_ids}


def parse_lines(text: str) -> dict[str, str]:
    """Blank lines, lines that begin with # and lines without a key are left out; the last of equal keys counts."""
    pairs = (line.strip().partition("=") for line in text.split("\n") if not line.strip().startswith("#"))
    return {key.strip(): value.strip() for key, sign, value in pairs if sign and key}


def _whole(value: str | None, default: int | None) -> int | None:
    """The whole number that a value begins with; the default where it begins with none."""
    found = re.match(r"\s*[+-]?\d+", value or "")
    return int(found[0]) if found else default


def load(text: str = "", env: Mapping[str, str] | None = None) -> Config:
    values = parse_lines(text) | dict(os.environ if env is None else env)
    d, number = Config(), lambda key, default: _whole(values.get(key), default)
    # A switch leaves its default for the other word only.
    on = lambda key, default: (values.get(key, default).lower() == "true") if default == "false" else (values.get(key, default).lower() != "false")
    return Config(
        root=values.get("DB_PATH") or d.root,
        parallelism=number("PARALLELISM", d.parallelism),
        chunk_size=number("CHUNK_SIZE", d.chunk_size),
        pretty_json=on("PRETTY_JSON", "false"),
        balance_shards=on("BALANCE_SHARDS", "true"),
        density_probes=number("DENSITY_PROBES", None) or None,
        auto_incremental=on("AUTO_INCREMENTAL", "true"),
        exact_archive_dedup=on("EXACT_ARCHIVE_DEDUP", "true"),
        archive_dedup_parts=number("ARCHIVE_DEDUP_PARTS", d.archive_dedup_parts),
        archive_dedup_max_ids=number("ARCHIVE_DEDUP_MAX_IDS", d.archive_dedup_max_ids),
        watch_interval_ms=number("WATCH_INTERVAL_MINUTES", 15) * 60_000,
        live_flush_interval_ms=number("LIVE_FLUSH_INTERVAL_MS", d.live_flush_interval_ms),
        live_batch_messages=number("LIVE_BATCH_MESSAGES", d.live_batch_messages),
        live_max_buffer=number("LIVE_MAX_BUFFER", d.live_max_buffer),
        log_level=values.get("LOG_LEVEL") or d.log_level,
    )


def read(spark, path: str, env: Mapping[str, str] | None = None) -> Config:
    """From a file on any file system that Spark reads; a missing file is an empty one."""
    files = Files(spark)
    return load(files.read(path) if files.exists(path) else "", env)
