"""md5 of packed words, many at once: the same values as ``seqs.stable_hash`` of their letters."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the hash function: rotations of its four rounds and its starting state.
ROTATIONS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
#: Which word of the message a step takes: (factor, offset) by round.
ORDER = ((1, 0), (5, 1), (3, 5), (7, 0))
#: Words hashed at once, so that the arrays stay in the processor's cache.
BLOCK = 32768


def _letters(n: int, tail: bytes) -> np.ndarray:
    """Little-endian 32-bit words of all n-letter words (n <= 4) followed by ``tail``."""
    codes = np.arange(4**n)[:, None] >> (2 * np.arange(n - 1, -1, -1)) & 3
    out = np.zeros((4**n, 4), np.uint8)
    out[:, :n] = np.frombuffer(b"ACGT", np.uint8)[codes]
    out[:, n : n + len(tail)] = np.frombuffer(tail, np.uint8)
    return out.view("<u4").ravel()


def _message(words: np.ndarray, k: int) -> list[np.ndarray | int]:
    full, rest = divmod(k, 4)
    table = _letters(4, b"")
    out: list[np.ndarray | int] = [table[words >> 2 * (k - 4 * j - 4) & 255] for j in range(full)]
    out.append(_letters(rest, b"\x80")[words & (4**rest - 1)] if rest else 0x80)
    return out + [0] * (14 - len(out)) + [8 * k, 0]


def _block(words: np.ndarray, k: int) -> np.ndarray:
    message = _message(words, k)
    a, b, c, d = (np.full(len(words), x, np.uint32) for x in START)
    t = np.empty(len(words), np.uint32)
    for i in range(64):
        r = i >> 4
        if r == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif r == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif r == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        factor, offset = ORDER[r]
        m = message[(factor * i + offset) % 16]
        a += t
        if isinstance(m, int):
            a += np.uint32((SINES[i] + m) & 0xFFFFFFFF)
        else:
            a += m
            a += np.uint32(SINES[i])
        n = ROTATIONS[r][i & 3]
        np.right_shift(a, np.uint32(32 - n), out=t)
        a <<= np.uint32(n)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return (a.byteswap().astype(np.int64) << 28) | (b.byteswap() >> np.uint32(4)).astype(np.int64)


def stable_hash(words: np.ndarray, k: int) -> np.ndarray:
    """The first 60 bits of the md5 of each packed word's letters."""
    parts = [_block(words[i : i + BLOCK], k) for i in range(0, len(words), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
