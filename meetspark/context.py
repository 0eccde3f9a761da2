"""Compiling with limits of one's own."""

from __future__ import annotations

from dataclasses import dataclass

from meetspark import sources
from meetspark.errors import Diagnostic, ParseError
from meetspark.plans import syntax as S
from meetspark.plans.evaluate import Instance, Schema


@dataclass(frozen=True)
class Context:
    """Limits on sources and data, and the ways to values under them."""

    max_source_bytes: int = S.MAX_SOURCE_BYTES
    max_parse_depth: int = S.MAX_PARSE_DEPTH
    max_decode_depth: int = sources.MAX_DEPTH

    def _text(self, source: str | bytes) -> str:
        try:
            return source.decode() if isinstance(source, bytes) else source
        except UnicodeDecodeError as e:
            raise ParseError(Diagnostic("source.invalid", "source is not UTF-8")) from e

    def scan_source(self, source: str | bytes) -> list[S.Token]:
        return S.scan(self._text(source), self.max_source_bytes)

    def parse_source(self, source: str | bytes) -> S.File:
        return S.parse(self._text(source), self.max_source_bytes, self.max_parse_depth)

    def compile_source(self, *texts: str | bytes) -> Schema:
        """The value of sources of one package."""
        instance = Instance([self.parse_source(x) for x in texts])
        return Schema(instance.value(), instance)

    def load(self, *args: str, **options) -> Schema:
        """See sources.load()."""
        return sources.load(*args, **options)

    def decode(self, text: str | bytes, format: str) -> Schema:
        return sources.decode(text, format, self.max_decode_depth)
