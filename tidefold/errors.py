"""Errors with stable codes: E2xx of grids, E3xx of execution."""

from __future__ import annotations


class TableError(Exception):
    """Base of all errors; the message starts with the code in brackets."""

    code = "E000"

    def __init__(self, message: str):
        super().__init__(f"[{self.code}] {message}")
        self.message = message


class TransposeError(TableError):
    code = "E204"


class ChunkingError(TableError):
    code = "E303"


class EngineIOError(TableError):
    code = "E304"
