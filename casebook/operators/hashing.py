"""MD5 of many short texts at once, as columns of numpy words.

A task that hashes each row with each of many numbers spends its time on the calls; here
a step of the hash is one operation on all rows.  Texts of more than one MD5 block go
through ``hashlib``.
"""

from __future__ import annotations

import hashlib
import math
from typing import Sequence

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
#: Bytes that one block has room for.
_ROOM = 55


def first_words(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """The first 8 hex digits of md5(head + tail) as numbers: heads x tails."""
    out = np.empty((len(heads), len(tails)), np.int64)
    sizes = np.array([len(h) for h in heads])
    longest = max(map(len, tails), default=0)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size + longest > _ROOM:
            for i in at:
                out[i] = [int(hashlib.md5(heads[i] + t).hexdigest()[:8], 16) for t in tails]
            continue
        block = np.zeros((len(at), 64), np.uint8)
        block[:, :size] = np.frombuffer(b"".join([heads[i] for i in at]), np.uint8).reshape(len(at), size)
        for j, tail in enumerate(tails):
            end = size + len(tail)
            block[:, size:end] = np.frombuffer(tail, np.uint8)
            block[:, end:] = 0
            block[:, end] = 0x80
            block[:, 56:58] = (8 * end & 255, 8 * end >> 8)
            words = block.view("<u4")
            # words of the head alone differ from row to row
            out[at, j] = _first([np.ascontiguousarray(words[:, i]) if 4 * i < size else int(words[0, i]) for i in range(16)], len(at))
    return out


def _first(words: list, n: int) -> np.ndarray:
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t = np.empty(n, np.uint32)
    for i in range(61):                                   # the last three steps don't change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        word = words[_WORD[i]]
        a += t
        if isinstance(word, int):
            a += np.uint32((_ADD[i] + word) & 0xFFFFFFFF)
        else:
            a += np.uint32(_ADD[i])
            a += word
        np.left_shift(a, np.uint32(_TURN[i]), out=t)
        a >>= np.uint32(32 - _TURN[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(0x67452301)
    return b.byteswap().astype(np.int64)
