"""Errors of the engine; each kind maps to an exit code and an HTTP status."""

from __future__ import annotations


class EngineError(Exception):
    status, exit_code = 500, 1


class NotFound(EngineError):
    status = 404


class IntegrityError(EngineError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"index integrity: {path}: {reason}")
        self.path, self.reason = path, reason


class ConfigError(EngineError):
    status = 400

    def __init__(self, field: str, reason: str):
        super().__init__(f"configuration: {field}: {reason}")
        self.field, self.reason = field, reason


class QueryError(EngineError):
    status = 400

    def __init__(self, position: int, reason: str):
        super().__init__(f"query: at {position}: {reason}")
        self.position, self.reason = position, reason


class UsageError(EngineError):
    status, exit_code = 400, 2

    def __init__(self, command: str, reason: str):
        super().__init__(f"{command}: {reason}" if command else reason)
        self.command, self.reason = command, reason
