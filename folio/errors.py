"""Errors, with the codes that clients rely on."""

from __future__ import annotations


class EngineError(Exception):
    code = 1

    def __init__(self, message: str, code: int | None = None) -> None:
        super().__init__(message)
        if code is not None:
            self.code = code


class BadValue(EngineError):
    code = 2


class UnsupportedOperator(EngineError):
    code = 9


class NamespaceNotFound(EngineError):
    code = 26


class CursorNotFound(EngineError):
    code = 43


class NamespaceExists(EngineError):
    code = 48


class CannotCreateIndex(EngineError):
    code = 67


class DocumentValidationFailure(EngineError):
    code = 121


class DocumentTooLarge(EngineError):
    code = 10334


class DuplicateKey(EngineError):
    code = 11000
