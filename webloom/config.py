"""Limits and intervals of the crawl, as parameters with the usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 13
    max_body_bytes: int = 5 * 1024 * 1024
    medium_bytes: int = 100 * 1024
    large_bytes: int = 500 * 1024
    extensions: tuple[str, ...] = (".pdf",)
    interface_queue: int = 50_000
    priority_queue: int = 50_000
    start_workers: int = 100
    max_workers: int = 800
    clients: int = 64
    retries: int = 3
    backoff_ms: int = 300
    enqueue_tries: int = 50
    enqueue_backoff_ms: int = 50
    rate: int = 100_000
    burst: int = 2_400
    logged_failures: int = 20


DEFAULT = CrawlConfig()
