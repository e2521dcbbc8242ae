"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 20


class _Powers:
    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -m, 2**64))])
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _split(raw: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    edge = np.diff(white.astype(np.int8), prepend=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _lower(texts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, and the sums that they are read from."""
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), sums


def _owner(texts: list[bytes], starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words [^\\x20\\x09-\\x0D]+ of the texts, A-Z lower-cased, and the number of the text that each belongs to."""
    raw = _lower(texts)
    starts, ends = _split(raw, (raw == 32) | ((raw >= 9) & (raw <= 13)))
    return _hashes(raw, starts, ends)[0], _owner(texts, starts)


def term_hashes(texts: list[bytes], stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of letters, digits and non-ASCII bytes, and of the beginnings of `stems` bytes of longer ones; and the text of each."""
    raw = _lower(texts)
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    starts, ends = _split(raw, ~inside)
    whole, sums = _hashes(raw, starts, ends)
    out, of = [whole], [_owner(texts, starts)]
    _, down = _POWERS.upto(len(raw) + 1)
    for m in stems:
        long = ends - starts > m
        at = starts[long]
        out.append(mix((sums[at + m] - sums[at]) * down[at] + np.uint64(m << 32)))
        of.append(of[0][long])
    return np.concatenate(out), np.concatenate(of)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    x = np.full(m, n, np.uint64)
    for k in range(n):
        x = mix(x * _STEP + words[k : k + m])
    return x


def chunks(texts: list[bytes], most: int = CHUNK_BYTES):
    """Neighbouring texts in lists of about `most` bytes."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; with fewer words, the whole sequence as one; without words, none."""
    out = []
    for part in chunks([(t or "").encode() for t in texts]):
        words, of = word_hashes(part)
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        runs = shingle_hashes(words, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(runs[a : b - n + 1]))
            elif b > a:
                out.append(shingle_hashes(words[a:b], b - a))
            else:
                out.append(runs[:0])
    return out
