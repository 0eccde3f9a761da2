"""Diagnostics: what is wrong with a schema, a path, a source or a value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    start: int = 0
    end: int = 0
    severity: str = "error"


class MeetError(Exception):
    """The base of all errors that this package raises."""

    def __init__(self, *found: Diagnostic | str):
        self.diagnostics = [x if isinstance(x, Diagnostic) else Diagnostic("error", x) for x in found]
        super().__init__("; ".join(f"{x.code}: {x.message}" for x in self.diagnostics))


class ParseError(MeetError):
    """A schema text that can't be parsed."""


class CompileError(MeetError):
    """A schema whose names, imports or literals can't be resolved."""


class EvalError(MeetError):
    """A value that is in conflict or, where it must be concrete, incomplete."""


class PathError(MeetError):
    """A path that can't be parsed or doesn't lead anywhere."""


class LoadError(MeetError):
    """Sources that can't be loaded."""


class DecodeError(MeetError):
    """Data that can't be decoded or exceeds a limit."""


class EncodeError(MeetError):
    """A value that a format can't hold."""
