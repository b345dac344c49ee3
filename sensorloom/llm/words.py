"""Words, lines and shingles of many texts at once, as numpy arrays.

Texts are cut on bytes: all characters outside ASCII are word characters, so UTF-8 needs no decoding.
Hashes are 64-bit sums of powers, finished by a bit mixer. Two different values meet with a chance of
about 2^-64 for a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)

#: Bytes that are summed up at once.
BLOCK = 1 << 17

#: Bytes of a word: what is not white space; digits, letters and all outside ASCII.
NOT_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)


def _inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those for usual sizes are kept."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        out = np.full(max(n, 1 << 16), base, dtype=U)
        out[0] = 1
        kept = np.cumprod(out)
        if len(kept) <= 1 << 21:
            _POWERS[int(base)] = kept
    return kept[:n]


def _sums(values: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """For each segment of ``buf`` the sum of its bytes' ``values`` * base^place, place counted from the segment's start.

    Segments are rising and apart. They are summed in blocks of about ``BLOCK`` bytes, so that eight bytes for each byte
    are held of one block only.
    """
    out = np.zeros(len(starts), dtype=U)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        n = int(ends[b - 1] - low)
        total = np.zeros(n + 1, dtype=U)
        np.multiply(values[buf[low:low + n]], _powers(base, n), out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        out[a:b] = (total[ends[a:b] - low] - total[starts[a:b] - low]) * _powers(_inverse(base), n + 1)[starts[a:b] - low]
        a = b
    return out


@dataclass
class Words:
    """Words of some texts: byte places in ``buf``, the text each is of, and a hash of each."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    n_texts: int

    def first(self) -> np.ndarray:
        """Place of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of all k words in a row."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        whole = self.text[:n] == self.text[k - 1:]
        at = np.flatnonzero(whole)
        out = np.zeros(len(at), dtype=U)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * _WORD_BASE + self.hashes[at + j]
        return self.text[at], mix(out)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash of a row of word hashes, as a 1-element array; as a shingle's of that length."""
    out = np.zeros(1, dtype=U)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _WORD_BASE + h
    return mix(out)


def cut(texts: list[bytes], word_bytes: np.ndarray = NOT_SPACE) -> Words:
    """Words of lower-cased (A-Z) texts. A line feed between texts ends words of either kind."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    inside = word_bytes[buf]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        sums = _sums(_BYTE, buf, starts, ends, _BASE)
        hashes = mix(sums + (ends - starts).astype(U) * _WORD_BASE)
    text = np.searchsorted(begins, starts, side="right") - 1
    return Words(buf, starts, ends, text, hashes, len(texts))
