"""Error codes of the request layer."""

from __future__ import annotations

NOT_FOUND, UNKNOWN_FIELD, INVALID, TENANT_REQUIRED, TENANT_MISMATCH, CHANGE_LOG, UNAUTHORISED, INTERNAL = 1001, 1002, 1003, 1004, 1005, 2001, 3001, 9999


class RequestError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def invalid(message: str) -> RequestError:
    return RequestError(INVALID, message)
