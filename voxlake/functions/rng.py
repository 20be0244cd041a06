"""Uniform numbers that depend on a key alone, so results do not depend on partitioning: the first 32 bits of an MD5."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import importable


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the parts joined by `:`; strings name columns, other constants are literals."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(*parts: Column | str | int) -> Column:
    """A standard normal by Box and Muller from two uniforms."""
    u = F.greatest(uniform(*parts, F.lit("a")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def rounds(n: int) -> int:
    """Rounds after which an order of n looks drawn: some six for each bit of n, and a few for small n."""
    return 6 * max(1, (n - 1).bit_length()) + 6


def permuted(index: Column, n: int, *parts: Column | str | int) -> Column:
    """A bijection of [0, n) that the parts (columns or constants) choose: index to index, without a sort, a list or a window.

    Swap or not (Hoang, Morris and Rogaway, 2012): in each round an index has a partner, key - index modulo n, and both move to each
    other's place or both stay, by one hash bit that is the same for both. So each round is a bijection for any n, and all are.
    A round is made for a whole Arrow batch at once.
    """
    importable(SparkSession.active())
    name = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])

    @F.arrow_udf("bigint")
    def run(index: pa.Array, name: pa.Array) -> pa.Array:
        names = name.dictionary_encode()
        at = index.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(_permuted(at, [x.encode() for x in names.dictionary.to_pylist()], names.indices.to_numpy(), n), mask=index.is_null().to_numpy(zero_copy_only=False))

    return run(index.cast("bigint"), name)


def _permuted(index: np.ndarray, names: list[bytes], which: np.ndarray, n: int) -> np.ndarray:
    """permuted for the indices of a batch; the name of each is names[which]. Names of one length are hashed together."""
    out, sizes = index.copy(), np.array([len(x) for x in names])
    for size in set(sizes.tolist()):
        own = np.flatnonzero(sizes == size)
        rows = np.flatnonzero(sizes[which] == size)
        x, of = index[rows], np.searchsorted(own, which[rows])
        for i in range(rounds(n)):
            heads = [b"%b:%d:" % (names[k], i) for k in own]
            keys = np.array([int(hashlib.md5(h + b"key").hexdigest()[:12], 16) % n for h in heads])
            partner = (keys[of] - x) % n
            x = np.where(_told(heads, of, np.maximum(x, partner)), partner, x)
        out[rows] = x
    return out


def _told(heads: list[bytes], of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the MD5 of heads[of] and the decimal number begins with a bit of 1. Heads have one length; no number is negative."""
    at, width = len(heads[0]), len(str(numbers.max(initial=0)))
    if at + width > 54 or width > 16:  # more than one block of MD5, or than the digits below
        return np.array([hashlib.md5(b"%b%d" % (heads[k], v)).digest()[0] > 127 for k, v in zip(of.tolist(), numbers.tolist(), strict=True)], bool)
    table = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16)
    words = [table[of, j] if 4 * j < at and len(heads) > 1 else table[0, j] for j in range(16)]
    size, digits = _digits(numbers, width)
    first, turn = at // 4, np.uint32(at % 4 * 8)
    for j, word in enumerate(digits, first):
        words[j] = words[j] | word << turn
        if turn:
            words[j + 1] = words[j + 1] | word >> np.uint32(32 - turn)
    words[14] = (8 * (at + size)).astype(np.uint32)
    return _md5_word(words, len(numbers)) & np.uint32(128) != 0


#: Four digits as the four bytes of a word; what a word keeps that has fewer; and the byte that MD5 puts after a text.
_FOUR = np.array([int.from_bytes(b"%04d" % i, "little") for i in range(10_000)], np.uint32)
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_MARK = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _digits(numbers: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many digits each number has (at most width, itself at most 16), and its text and the byte after it in words of four bytes."""
    size = np.ones(len(numbers), np.int64)
    for j in range(1, width):
        size += numbers >= 10**j
    fours = -(-width // 4)
    rest, words = numbers * (10 ** np.arange(4 * fours))[4 * fours - size], [np.uint32(0)] * fours
    for j in reversed(range(fours)):
        more = rest // 10_000
        words[j], rest = _FOUR[rest - 10_000 * more], more
    words += [np.uint32(0)] * (width // 4 + 1 - fours)
    left = [np.clip(size - 4 * j, -1, 4) + 1 for j in range(len(words))]
    return size, [word & _KEPT[n] | _MARK[n] for word, n in zip(words, left, strict=True)]


#: MD5's steps (RFC 1321): the number added, how far the sum is turned, and the word of the text.
_STEPS = [(int(abs(math.sin(i + 1)) * 2**32), ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4], (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16) for i in range(64)]


def _md5_word(words: list[np.ndarray | np.uint32], n: int) -> np.ndarray:
    """The first word of the MD5 of n texts of one block, whose 16 words are arrays or the same for all. Steps 61 to 63 make the other words."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (add, turn, word) in enumerate(_STEPS[:61]):
        if i < 16:  # (b and c) or (not b and d)
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # (d and b) or (not d and c)
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        if words[word].ndim:
            np.add(f, words[word], out=f)
            np.add(f, np.uint32(add), out=f)
        else:
            np.add(f, np.uint32((add + int(words[word])) % 2**32), out=f)
        np.add(a, f, out=a)
        np.left_shift(a, np.uint32(turn), out=t)
        np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(0x67452301)


def permuted_index(index: int, n: int, *parts: str | int) -> int:
    """The driver's form of permuted."""
    md5 = lambda *x: hashlib.md5(":".join(map(str, (*parts, *x))).encode()).hexdigest()
    for i in range(rounds(n)):
        partner = (int(md5(i, "key")[:12], 16) % n - index) % n
        if md5(i, max(index, partner)) >= "8":
            index = partner
    return index
