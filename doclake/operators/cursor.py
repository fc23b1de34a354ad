"""Page cursors: a sealed position in a listing, refused once the catalog, the question or the row before it has changed.

A cursor is a fixed binary record (version, catalog revision, offset, digest of the
question, digest of the last row's key) under a keyed seal, written in base 32.
"""

from __future__ import annotations

import base64
import binascii
import struct
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import Column, DataFrame

# Form version and bounds of a listing.
VERSION, WINDOW, MAX_LIMIT = 1, 5000, 1000
_RECORD, _SEAL = struct.Struct(">BQI8s8s"), 5
_KEY = b"doclake listing position"


class CursorError(ValueError):
    pass


def digest(*parts: object) -> bytes:
    """Eight bytes for a question (its command and arguments) or for a row's key."""
    return blake2b("\x1f".join(map(repr, parts)).encode(), digest_size=8).digest()


def question(command: str, **arguments: object) -> bytes:
    return digest(command, *sorted(arguments.items()))


@dataclass(frozen=True)
class Cursor:
    revision: int
    offset: int
    question: bytes
    anchor: bytes

    def __str__(self) -> str:
        record = _RECORD.pack(VERSION, self.revision, self.offset, self.question, self.anchor)
        return base64.b32encode(record + blake2b(record, digest_size=_SEAL, key=_KEY).digest()).decode().rstrip("=").lower()

    @classmethod
    def read(cls, text: str) -> Cursor:
        try:
            whole = base64.b32decode(text.upper().ljust(-(-len(text) // 8) * 8, "="))
        except (binascii.Error, ValueError) as problem:
            raise CursorError("not a cursor") from problem
        record, seal = whole[: _RECORD.size], whole[_RECORD.size :]
        if len(record) < _RECORD.size or blake2b(record, digest_size=_SEAL, key=_KEY).digest() != seal:
            raise CursorError("not a cursor, or not a whole one")
        version, *fields = _RECORD.unpack(record)
        if version != VERSION:
            raise CursorError(f"a cursor of form {version}")
        return cls(*fields)


@dataclass(frozen=True)
class Listing:
    """One question to one state of the catalog."""

    revision: int
    question: bytes

    def start(self, text: str | None, key_at: Callable[[int], str] | None = None) -> int:
        """Where to go on; ``key_at(i)`` gives the key of row i, to notice rows that moved."""
        if not text:
            return 0
        cursor = Cursor.read(text)
        if cursor.question != self.question:
            raise CursorError("the cursor answers another question")
        moved = key_at is not None and cursor.offset > 0 and digest(key_at(cursor.offset - 1)) != cursor.anchor
        if cursor.revision != self.revision or moved:
            raise CursorError("the catalog has changed since this page")
        return cursor.offset

    def following(self, start: int, keys: list[str], more: bool) -> str | None:
        """The cursor after a page; none at the end or past the window."""
        end = start + len(keys)
        if not keys or not more or end >= WINDOW:
            return None
        return str(Cursor(self.revision, end, self.question, digest(keys[-1])))


def checked_limit(limit: int) -> int:
    """A page's size; out of bounds is refused, not clamped."""
    if not 1 <= limit <= MAX_LIMIT:
        raise CursorError(f"a page holds 1 to {MAX_LIMIT} rows")
    return limit


def page(rows: DataFrame, order: list[Column | str], limit: int, start: int = 0) -> DataFrame:
    """``limit`` rows from ``start`` and one more, which tells whether there are further ones."""
    if start + checked_limit(limit) > WINDOW:
        raise CursorError(f"a listing is paged through its first {WINDOW} rows")
    return rows.orderBy(*order).offset(start).limit(limit + 1)
