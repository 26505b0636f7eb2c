"""Vectorised hashing of words and character n-grams over blocks of whole texts.

A block is several texts laid end to end as code points, each followed by a line
feed, so that no n-gram or word reaches into the next text.  Blocks bound the
memory of a task: a block closes once it holds BLOCK code points.  A text longer than
two blocks goes in pieces, cut at white space; every character of it is in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(texts: Sequence[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) with null as empty; each block is closed at limit code points."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t if isinstance(t, str) else "")
        total += len(held[-1]) + 1
        if total >= limit:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


def split(text: str, limit: int = BLOCK) -> Iterator[str]:
    """The text in pieces of at most about limit code points, cut at white space, so that no word is cut.

    A run without white space that is longer than the limit is cut inside.
    """
    at = 0
    while len(text) - at > limit:
        found = _SPACE.search(text, at + limit // 2, at + limit)
        cut = found.end() if found else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:]


_SPACE = re.compile(r"\s")


def bounded(texts: Sequence[str | None], limit: int | None = None) -> Iterator[tuple[int, list[str], bool]]:
    """``blocks``, but that a text of more than two blocks comes in pieces of its own: (index, texts, whether it is such a piece)."""
    limit = BLOCK if limit is None else limit
    for first, held in blocks(texts, limit):
        if max(map(len, held)) <= 2 * limit:
            yield first, held, False
            continue
        for i, t in enumerate(held):
            if len(t) <= 2 * limit:
                yield first + i, [t], False
            else:
                for piece in split(t, limit):
                    yield first + i, [piece], True


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line feed after each, and the offsets of texts (one more than texts)."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return code, np.concatenate(([0], ends))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    have = 1
    step = base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = step * step
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        with np.errstate(over="ignore"):
            _tables[size] = _powers(_B, size), _powers(_INV, size)
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of code[start:end] for every span, the same wherever the span stands."""
    power, inverse = _tables_for(len(code) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts])


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of code points, by start; empty if code is shorter."""
    if len(code) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, width = None, 0
        part, size = code.astype(np.uint64) + np.uint64(1), 1
        left = n
        while left:
            if left & 1:
                if out is None:
                    out, width = part, size
                else:
                    m = min(len(out), len(part) - width)
                    out = out[:m] + part[width : width + m] * _powers(_B, width + 1)[width]
                    width += size
            left >>= 1
            if left:
                part = part[: len(part) - size] + part[size:] * _powers(_B, size + 1)[size]
                size *= 2
        return mix(out[: len(code) - n + 1])
