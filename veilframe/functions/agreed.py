"""Patterns on which the engine's regular expressions and Python's agree, match by match.

Both search from the left, try alternatives in order and repeat greedily or lazily; they differ in classes, borders, flags,
case folding beyond ASCII, repeated groups and empty matches. ``agreed`` lets through what has none of these: ASCII characters
and classes of them, alternatives, groups that are not repeated, repeated single characters, ``^`` before anything else of
an alternative, and ``(?i)`` at the front. Whatever else there is in a pattern, it is the engine's alone.
"""

from __future__ import annotations

import re

#: Characters outside ASCII that equal an ASCII letter without case; with ``(?i)`` texts that hold one are the engine's.
BLIND = "İıſK"
_LITERAL = re.compile(r"[A-Za-z0-9 @_/:;,=<>!\"'%#-]|\\[.@/:;,=<>!%#$^*+?()\[\]{}|\\-]")
_CLASS = re.compile(r"\[(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9 @_./:;,=])+\]")
_TIMES = re.compile(r"(?:[*+?]|\{(\d{1,3})(?:,(\d{0,3}))?\})\??(?![*+?{])")


class _Other(Exception):
    """The pattern is not one of those."""


def _alternatives(text: str, at: int, depth: int) -> tuple[int, bool]:
    """(place behind, whether nothing at all can match) of the alternatives that begin at a place."""
    empty = False
    while True:
        start, none = at, True
        while at < len(text) and text[at] not in "|)":
            if text[at] == "^" and depth == 0 and at == start:
                at += 1
                continue
            if text[at] == "(":
                begin = at + 3 if text.startswith("(?:", at) else at + 1
                if text.startswith("?", begin) or depth > 20:
                    raise _Other
                at, may = _alternatives(text, begin, depth + 1)
                if not text.startswith(")", at) or _TIMES.match(text, at + 1) or text[at + 1 : at + 2] in ("*", "+", "?", "{"):
                    raise _Other
                at, none = at + 1, none and may
                continue
            one = _CLASS.match(text, at) or _LITERAL.match(text, at)
            if one is None or any(a > b for a, b in re.findall(r"(\w)-(\w)", one[0])):
                raise _Other
            at = one.end()
            may = False
            if text[at : at + 1] in ("*", "+", "?", "{"):
                times = _TIMES.match(text, at)
                if times is None or (times[2] and int(times[2]) < int(times[1])):
                    raise _Other
                may = times[0][0] in "*?" or times[1] is not None and int(times[1]) == 0
                at = times.end()
            none = none and may
        empty = empty or none
        if text[at : at + 1] != "|":
            return at, empty
        at += 1


def agreed(pattern: str) -> tuple[re.Pattern, bool] | None:
    """The pattern for Python and whether it is blind to case, or None if it is the engine's alone."""
    blind = pattern.startswith("(?i)")
    body = pattern[4:] if blind else pattern
    try:
        end, empty = _alternatives(body, 0, 0)
        if end < len(body) or empty:
            return None
        return re.compile(body, re.IGNORECASE if blind else 0), blind
    except (_Other, re.error, OverflowError):
        return None
