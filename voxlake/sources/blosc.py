"""Decoding of Blosc 1 chunks, the usual compressor of zarr v2 arrays: all five codecs inside, with byte shuffle, bit shuffle or none.

A chunk is a header of 16 bytes, the offsets of its blocks, and blocks of one stream, or of one for each byte of a value.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Codec numbers of the format's flags (bits 5 to 7), its flag bits and the bounds within which blocks are split.
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
SHUFFLED, COPIED, BIT_SHUFFLED, WHOLE = 1, 2, 4, 16
MOST_STREAMS, LEAST_STREAM = 16, 128


#: Fixed values of BloscLZ: the largest near distance, and the length that says that more length bytes follow.
NEAR, LONG = 8191, 6


def blosclz(data: bytes) -> bytes:
    """An LZ77 stream: an instruction below 32 copies so many bytes and one more from the input; others repeat what has been written.

    Such a repeat has its length in the upper three bits, which bytes of 255 and a last one extend, and its distance in the lower five
    and a byte; a distance of all ones is a far one, and two more bytes add to it.
    """
    out, at, end = bytearray(), 1, len(data)
    step = data[0] & 31
    while True:
        if step < 32:
            out += data[at : at + step + 1]
            at += step + 1
        else:
            n, back = (step >> 5) - 1, (step & 31) << 8
            if n == LONG:
                more = 255
                while more == 255:
                    more = data[at]
                    n += more
                    at += 1
            low = data[at]
            at += 1
            far = low == 255 and back == 31 << 8
            back += low
            if far:
                back = NEAR + int.from_bytes(data[at : at + 2], "big")
                at += 2
            n, back = n + 3, back + 1
            if back > len(out):
                raise ValueError("a blosclz stream refers to bytes before its beginning")
            said = bytes(out[-back : len(out) - back + n] if back > n else out[-back:])
            out += (said * (n // len(said) + 1))[:n]
        if at >= end:
            return bytes(out)
        step = data[at]
        at += 1


def unshuffled_bits(data: bytes, width: int) -> bytes:
    """Planes of the k-th bit of all values, back to values; a block whose number of values is no multiple of 8 is stored as it is."""
    n = len(data) // width
    if n % 8 or not n:
        return data
    planes = np.unpackbits(np.frombuffer(data[: n * width], np.uint8).reshape(8 * width, n // 8), axis=1, bitorder="little")
    return np.packbits(planes.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def _stream(kind: str, data: bytes, size: int) -> bytes:
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "blosclz":
        return blosclz(data)
    return pa.Codec("lz4_raw" if kind == "lz4" else kind).decompress(data, size, asbytes=True)


def decode(data: bytes) -> bytes:
    _, _, flags, width, size, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & COPIED:
        return data[16 : 16 + size]
    kind, out = CODECS.get(flags >> 5, "unknown"), []
    if kind == "unknown":
        raise ValueError(f"codec {flags >> 5} inside blosc is not known")
    starts = struct.unpack_from(f"<{-(-size // block) if block else 0}i", data, 16)
    for i, at in enumerate(starts):
        n = min(block, size - i * block)
        split = not flags & WHOLE and n == block and 1 < width <= MOST_STREAMS and block // width >= LEAST_STREAM
        parts, of_each = [], n // width if split else n
        for _ in range(width if split else 1):
            (stored,) = struct.unpack_from("<i", data, at)
            raw = data[at + 4 : at + 4 + stored]
            parts.append(raw if stored == of_each else _stream(kind, raw, of_each))
            at += 4 + stored
        whole = b"".join(parts)
        if flags & SHUFFLED and width > 1:
            even = n // width * width
            whole = np.frombuffer(whole[:even], np.uint8).reshape(width, -1).T.tobytes() + whole[even:]
        elif flags & BIT_SHUFFLED:
            whole = unshuffled_bits(whole, width)
        if len(whole) != n:
            raise ValueError(f"a block of a blosc chunk has {len(whole)} bytes, not {n}")
        out.append(whole)
    return b"".join(out)
