"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that every operator must take: null, empty, blank, ties, repeats, other scripts, one long text.
HARD = [
    None, "", " ", "\n\t\r\x0b\x0c ", "a", "a", "a b", "A b", "a a a a a a a a", "x y z x y z x y z x y z",
    "Zürich straße ÉCOLE don't we'll 12,345.67 ½ × ÷ İstanbul", "日本語 テキスト 中文 без 🎉🎉",
    "line one\nline one\n\n \nline one \nline two\r\nline two\r\n", "#*$%&|<>" * 9, "é" * 300, "nul \x00 \x1c \x85 \xa0 end",
    "<|endoftext|> and <|startoftext|> inside", "one two three four five six seven " * 40, "word " * 3000, "z" * 5000,
]


def words(text):
    return WORD.findall(text or "")


def find_root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def fingerprint(text, size=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(ids, prints, bits=2):
    parent = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[find_root(parent, i)] = find_root(parent, j)
    least = {}
    for i, d in enumerate(ids):
        r = find_root(parent, i)
        least[r] = min(least.get(r, d), d)
    return [least[find_root(parent, i)] for i in range(len(ids))]


def cut_windows(texts, size=35):
    seen = Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _in_repeats(w, size):
    seen = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    hit = [False] * len(w)
    for i in range(len(w) - size + 1):
        if seen[tuple(w[i : i + size])] > 1:
            hit[i : i + size] = [True] * size
    return sum(hit)


def quality(text, repeat_words=8):
    text = text or ""
    w = words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    repeat, cover = _in_repeats(w, 3), _in_repeats(w, repeat_words)
    longest = 0
    for i in range(len(w) if len(w) < 400 else 0):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, cover, longest, failed


def check_pieces(documents, pieces, capacity=2048):
    """``documents``: id -> token ids with the end id; pieces: (id, start, length, crc, doc_tokens, sequence, offset)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, length, crc, total, sequence, offset in pieces:
        ids = documents[d]
        assert total == len(ids) and length > 0
        part = b"".join(x.to_bytes(4, "little") for x in ids[start : start + length])
        assert zlib.crc32(part) == crc
        by_doc[d].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(documents)
    for spans in (by_doc, by_sequence):
        for key, parts in spans.items():
            at = 0
            for begin, length in sorted(parts):
                assert begin == at
                at += length
            if spans is by_doc:
                assert at == len(documents[key])
            else:
                assert at <= capacity
    fills = [sum(n for _, n in parts) for parts in by_sequence.values()]
    padding = sum(capacity - f for f in fills if f & (f - 1))
    return padding / max(1, sum(fills))
