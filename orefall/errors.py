"""Errors with a code that callers and tools can act on."""

from __future__ import annotations


class CodedError(ValueError):
    """code: stable name of the cause. status: the HTTP status a service would answer with."""

    def __init__(self, code: str, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.code, self.status = code, status
