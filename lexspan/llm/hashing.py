"""Vectorised hashes over code points, shared by the span and the similarity operators."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size + 1, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hash(cp: np.ndarray, salt: int = 0) -> np.ndarray:
    """P with P[b] - P[a] = the hash of cp[a:b], times BASE**a; another salt is another hash function."""
    pw, _ = powers(len(cp))
    out = np.zeros(len(cp) + 1, U)
    np.cumsum(mix(cp + U(salt)) * pw[: len(cp)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans [a, b), equal for equal content wherever it stands."""
    _, inverse = powers(len(prefix) - 1)
    return mix((prefix[b] - prefix[a]) * inverse[a])


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w neighbours, by doubling: log2(w) passes instead of w."""
    have = 1
    while have * 2 <= w:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (w - have)], a[w - have :]) if have < w else a


def blocks_of(values, size_of, limit: int):
    """Consecutive values in lists of a total size of about limit."""
    block, total = [], 0
    for v in values:
        block.append(v)
        total += size_of(v)
        if total >= limit:
            yield block
            block, total = [], 0
    if block:
        yield block
