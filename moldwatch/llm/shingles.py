"""Word shingles of many texts at once, in numpy (used inside tasks)."""
from __future__ import annotations

import numpy as np

U = np.uint64
M1, M2, M3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U(33))
    x = x * M1
    x ^= x >> U(33)
    x *= M2
    x ^= x >> U(33)
    return x


def times(k: int, by: int = int(M3)) -> np.uint64:
    """k * by modulo 2^64."""
    return U(k * by & 0xFFFFFFFFFFFFFFFF)


_byte = np.arange(256, dtype=np.uint8)
_upper = (_byte >= 65) & (_byte <= 90)
LOWER = np.where(_upper, _byte + 32, _byte).astype(np.uint8)
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
BYTE_VALUE = mix((np.arange(256, dtype=U) + U(1)) * M3)
_PRIME = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            table = np.full(size, U(base))
            table[0] = U(1)
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered texts, in
    order, and each word's text number.  A word's hash is a polynomial over its bytes,
    taken from running sums over all texts together."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(data))
    sums = BYTE_VALUE[LOWER[data]]
    sums *= power[:len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], U(0))
    hashes = mix((sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(U))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(bounds, starts, "right")


def shingle_counts(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``words`` consecutive words of each text: text number, hash, count,
    ordered by text and hash.  A text of fewer words, but not none, has one shingle."""
    h, doc = word_hashes(texts)
    n = len(texts)
    own = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(own)[:-1]]) if n else np.zeros(0, np.int64)
    salted = [mix(h + times(k + 1)) for k in range(words)]
    full = np.zeros(max(0, len(h) - words + 1), U)
    for k in range(words):
        full += salted[k][k:len(full) + k] * U(2 * k + 1)
    whole = doc[:len(full)] == doc[words - 1:] if len(full) else np.zeros(0, bool)
    sh, sd = mix(full[whole]), doc[:len(full)][whole]
    short = np.flatnonzero((own > 0) & (own < words))
    if len(short):
        some = np.array([mix(np.array([sum(int(salted[k][first[d] + k]) * (2 * k + 1) for k in range(own[d]))
                                       + int(own[d]) & 0xFFFFFFFFFFFFFFFF], U))[0] for d in short], U)
        sh, sd = np.concatenate([sh, some]), np.concatenate([sd, short])
        order = np.argsort(sd, kind="stable")
        sh, sd = sh[order], sd[order]
    sizes = np.bincount(sd, minlength=n)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(n):
        sh[at[d]:at[d + 1]].sort()
    if not len(sh):
        return sd, sh, np.zeros(0, np.int64)
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    place = np.flatnonzero(new)
    return sd[place], sh[place], np.diff(np.append(place, len(sh)))
