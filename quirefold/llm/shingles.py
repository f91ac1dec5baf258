"""Words of the raw-text contracts as 64-bit hashes, and windows over them, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed at once.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


_GOLDEN = 0x9E3779B97F4A7C15
_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE, _INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def split(text: str | None, lower: bool) -> list[bytes]:
    """The runs of anything but blank and tab to carriage return: what bytes.split() gives; it lowers A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def _hash_slice(raw: list[bytes]) -> list[np.ndarray]:
    """The hash of each word of each text: a polynomial over its bytes, by differences of running sums."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _power(len(data))
    space = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turn = np.concatenate(([0], turn))
    starts, ends = turn[0::2], turn[1::2]
    with np.errstate(over="ignore"):
        sums = np.cumsum(_VALUE[data] * up[: len(data)])
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        h = (sums[ends - 1] - before) * down[starts]
        h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_GOLDEN)))
    limits = np.cumsum([len(r) + 1 for r in raw])[:-1]
    return np.split(h, np.searchsorted(starts, limits))


def hash_texts(texts: Iterable[str | None], lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text, made for about ``SLICE`` bytes of text at once."""
    raw: list[bytes] = []
    held = 0
    for text in texts:
        r = (text or "").encode("utf-8", "surrogatepass")
        raw.append(r.lower() if lower else r)
        held += len(r)
        if held >= SLICE:
            yield from _hash_slice(raw)
            raw, held = [], 0
    if raw:
        yield from _hash_slice(raw)


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width + 1000 * salt, np.uint64)
    with np.errstate(over="ignore"):
        base = hashes if not salt else mix(hashes ^ np.uint64(_GOLDEN * salt & 0xFFFFFFFFFFFFFFFF))
        for k in range(width):
            out = out * np.uint64(_GOLDEN) + base[k : k + n]
    return mix(out)


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words than ``width`` the whole sequence is the only one."""
    for h in hash_texts(texts, lower=True):
        s = np.sort(windows(h, min(width, len(h)))) if len(h) else h
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return next(shingle_sets([text], width))
