"""Settings with their defaults; invalid combinations are refused at once."""

from __future__ import annotations

from dataclasses import dataclass

from orefall.errors import CodedError


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 0
    parent_size: int = 1600
    parent_expansion: bool = False
    dimensions: int = 1024
    sql_row_cap: int = 200
    sql_row_bytes: int = 1024 * 1024
    sql_timeout_ms: int = 5000
    max_steps: int = 6
    evidence_tokens: int = 4000
    evidence_limit: int = 12
    candidate_pool: int = 12
    history_turns: int = 6
    history_tokens: int = 8000
    ingest_attempts: int = 3
    lease_seconds: int = 3600
    retry_seconds: int = 5
    stale_seconds: int = 900
    upload_bytes: int = 20 * 1024 * 1024

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise CodedError("invalid_config", "chunk_overlap must be less than chunk_size")
        if self.parent_size < self.chunk_size:
            raise CodedError("invalid_config", "parent_size must be at least chunk_size")
        for name, value in self.__dict__.items():
            if name not in ("chunk_overlap", "parent_expansion") and value <= 0:
                raise CodedError("invalid_config", f"{name} must be positive")


@dataclass(frozen=True)
class User:
    user_id: str
    name: str = ""
    is_admin: bool = False
