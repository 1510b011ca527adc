"""Which rules may match a text at all: the recognizers' necessary conditions, checked for batches of texts.

The engine's patterns backtrack and decode a text anew for each pattern. The conditions need neither: they are regular
expressions of RE2, which run over the bytes of a whole Arrow batch in one linear pass each. A few rules share a first
pass, and only texts that pass it are checked for each of them. Only the numbers of the rules come back; the texts stay in
their rows, and the patterns themselves run in the engine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.recognizers import Recognizer

#: Rules that share a first pass.
GROUP = 4

_DIGIT, _SPACE = r"\p{Nd}", r"\t-\r \x{85}\p{Z}"


def in_re2(pattern: str) -> str:
    """A condition with digits and white space as the engine understands them (Unicode)."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == r"\d":
            token = _DIGIT
        elif token == r"\s":
            token = _SPACE if inside else f"[{_SPACE}]"
        elif token.startswith(r"\u"):
            token, i = f"\\x{{{pattern[i : i + 4]}}}", i + 4
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return "".join(out)


def _any(parts: Sequence[str]) -> str:
    return f"(?:{'|'.join(parts)})"


def _understood(part: str) -> bool:
    """Whether RE2 can run a condition. One that it refuses is left out: fewer texts are spared, none is lost."""
    try:
        pc.match_substring_regex(pa.array([""]), part)
    except pa.ArrowInvalid:
        return False
    return True


def needs(rec: Recognizer) -> list[str]:
    """Expressions that all must occur in a text for a recognizer to match; none if it has no conditions."""
    words = [f"(?i:(?:^|[^a-z]){_any([re.escape(w) for w in rec.words])})"] if rec.words else []
    named = words + ([f"(?i:{_any([re.escape(h) for h in rec.folded])})"] if rec.folded else [])
    shaped = [f"(?:{in_re2(rec.digits)})"] if rec.digits else []
    parts = [f"(?:{in_re2(rec.guard)})"] if rec.guard else []
    if rec.digits_alone:
        parts.append(_any([*named, *shaped]))
    else:
        parts += [_any(named)] if named else []
        parts += shaped
    parts += [_any([re.escape(h) for h in rec.hints])] if rec.hints else []
    parts += [f"(?s:{'.*'.join([re.escape(token)] * least)})" for token, least in rec.counts]
    return [p for p in parts if _understood(p)]


def near_rules(text: Column, recognizers: Sequence[Recognizer]) -> Column | None:
    """``array<int>``: of the recognizers with conditions the places of those that may match; None if none has any."""
    checked = [(i, parts) for i, parts in enumerate(map(needs, recognizers)) if parts]
    if not checked:
        return None
    groups = [(_any([parts[0] for _, parts in some]), some) for some in (checked[k : k + GROUP] for k in range(0, len(checked), GROUP))]

    @F.arrow_udf("array<int>")
    def near(texts: pa.Array) -> pa.Array:
        import numpy as np

        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for first, some in groups:
            met = pc.indices_nonzero(pc.match_substring_regex(texts, first))
            left = texts.take(met)
            for place, parts in some:
                at, held = met, left
                for part in parts:
                    if len(at) == 0:
                        break
                    hit = pc.indices_nonzero(pc.match_substring_regex(held, part))
                    at, held = at.take(hit), held.take(hit)
                rows.append(at.to_numpy().astype(np.int64))
                places.append(np.full(len(at), place, np.int32))
        row, place = np.concatenate(rows), np.concatenate(places)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place[np.argsort(row, kind="stable")]))

    # Bytes that are no UTF-8 are replaced as the engine's patterns see them.
    return near(F.make_valid_utf8(text))
