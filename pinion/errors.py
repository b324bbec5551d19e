"""Status codes, the exception that carries one, and the per-row result of a write batch."""

from __future__ import annotations

from dataclasses import dataclass

OK = "Ok"
INVALID_ARGUMENT = "InvalidArgument"
NOT_FOUND = "NotFound"
ALREADY_EXISTS = "AlreadyExists"
PERMISSION_DENIED = "PermissionDenied"
FAILED_PRECONDITION = "FailedPrecondition"
INTERNAL = "Internal"


class StatusError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> StatusError:
    return StatusError(INVALID_ARGUMENT, message)


@dataclass(frozen=True)
class WriteResult:
    id: str
    code: str = OK
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.code == OK

    def to_json(self) -> dict:
        return {"id": self.id, "status": {"code": self.code, "message": self.message}}
