"""Settings, validated on construction; read from YAML where a file is given."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    strategy: str = "rrf"
    top_k: int = 5
    shortlist: int = 15
    rrf_k: int = 60
    overfetch: int = 3
    boost: float = 0.10
    max_features: int = 20_000
    min_df: int = 2
    embedding_dim: int = 1024
    max_upload_bytes: int = 15 * 1024 * 1024
    excerpt: int = 3000
    poll_seconds: int = 300
    ingest_retries: int = 2
    ingest_wait_s: float = 60.0
    listed_ids: int = 100
    buckets: int = 64
    scorer_retries: int = 3
    scorer_concurrent: int = 5
    scorer_tasks: int = 4
    scorer_timeout_s: float = 60.0

    def __post_init__(self):
        if self.strategy not in ("semantic", "tfidf", "rrf", "llm"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be between 1 and 50")

    @classmethod
    def load(cls, path: str) -> "Settings":
        import yaml

        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)
