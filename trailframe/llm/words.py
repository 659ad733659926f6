"""Word and window hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``
(the regular expression ``[^\\x20\\x09-\\x0D]+``; all of these are single
bytes in UTF-8, so words can be cut on bytes).  Hashes are polynomial sums
modulo 2**64 read off prefix sums, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
P_BYTE = 0x9E3779B97F4A7C15
P_WORD = 0xD6E8FEB86659FD93
SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)

_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**i`` and ``p**-i`` modulo 2**64 for i up to n."""
    have = _POW.get(p)
    if have is None or have[0].size <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        inv = pow(p, -1, 1 << 64)
        out = []
        for base in (p, inv):
            a = np.full(size, base, dtype=U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        if size > 1 << 22:  # unusually long text: not kept
            return out[0], out[1]
        _POW[p] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def cut_words(data: bytes, lower: bool = False):
    """Start and end byte offsets of the words of ``data``, and their hashes."""
    b = np.frombuffer(data, dtype=np.uint8)
    if b.size == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=U)
    word = ~_WS[b]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [b.size]))
    start, end = edge[0::2], edge[1::2]
    fwd, inv = powers(P_BYTE, b.size)
    if lower:
        b = _LOW[b]
    total = np.zeros(b.size + 1, dtype=U)
    np.cumsum((b.astype(U) + U(1)) * fwd[: b.size], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    return start, end, mix(h + (end - start).astype(U) * U(SEEDS[0]))


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = h.size - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    if seed:
        h = mix(h + U(SEEDS[seed]))
    fwd, inv = powers(P_WORD, h.size)
    total = np.zeros(h.size + 1, dtype=U)
    np.cumsum(h * fwd[: h.size], out=total[1:])
    return mix((total[size:] - total[:-size]) * inv[:n])


def batches(texts, limit: int = 1 << 18):
    """Slices of an Arrow text column (null: empty) of about ``limit`` bytes,
    as ``(first, [bytes])``; a longer text is a slice of its own."""
    first, part, size = 0, [], 0
    wide = pa.types.is_large_string(texts.type)
    for i, t in enumerate(texts.cast(pa.large_binary() if wide else pa.binary()).to_pylist()):
        b = t or b""
        if part and size + len(b) > limit:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield first, part


def batch_words(part: list[bytes], lower: bool = False):
    """Words of several texts at once: ``(data, start, end, hash, bounds)``;
    the words of text i are ``bounds[i]:bounds[i + 1]``."""
    data = b"\n".join(part)
    start, end, h = cut_words(data, lower)
    ends = np.cumsum([len(p) + 1 for p in part])
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    return data, start, end, h, bounds
