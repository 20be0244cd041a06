import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from voxlake.sources import blosc, ngff


def lz(data: bytes) -> bytes:
    """A BloscLZ stream: literals, and repeats of what stands up to 73,727 bytes before."""
    out, plain, seen, i = b"", b"", {}, 0

    def said(plain):
        return b"".join(bytes([len(plain[k : k + 32]) - 1]) + plain[k : k + 32] for k in range(0, len(plain), 32))

    while i < len(data):
        at = seen.get(data[i : i + 4])
        seen[data[i : i + 4]] = i
        if not out and not plain or at is None or i - at - 1 > 8191 + 65535 or len(data) - i < 6:
            plain += data[i : i + 1]
            i += 1
            continue
        n = 4
        while i + n < len(data) - 2 and data[at + n] == data[i + n]:
            n += 1
        d, rest = i - at - 1, n - 3 - 6
        near = d < 8191
        high, low = (d >> 8, d & 255) if near else (31, 255)
        out += said(plain) + bytes([min(n - 2, 7) << 5 | high]) + (b"\xff" * (rest // 255) + bytes([rest % 255]) if rest >= 0 else b"") + bytes([low]) + (b"" if near else (d - 8191).to_bytes(2, "big"))
        plain, i = b"", i + n
    return out + said(plain)


def bit_planes(data: bytes, width: int) -> bytes:
    n = len(data) // width
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data[: n * width], np.uint8).reshape(n, width), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def packed(data: bytes, width: int, block: int, kind: str, shuffle: bool | str, split: bool) -> bytes:
    """A chunk written by the format's rules, to decode again."""
    codec = {"blosclz": 0, "lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[kind]
    squeeze = zlib.compress if kind == "zlib" else lz if kind == "blosclz" else lambda x: pa.Codec("lz4_raw" if kind == "lz4" else kind).compress(x, asbytes=True)
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    body, starts, at = b"", [], 16 + 4 * len(blocks)
    for b in blocks:
        starts.append(at + len(body))
        even = len(b) // width * width
        if shuffle == "bits":
            b = bit_planes(b, width)
        elif shuffle:
            b = np.frombuffer(b[:even], np.uint8).reshape(-1, width).T.tobytes() + b[even:]
        n = len(b) // width if split and len(b) == block and block // width >= 128 else len(b)
        for i in range(0, len(b), n):
            part = squeeze(b[i : i + n])
            part = part if len(part) < n else b[i : i + n]
            body += struct.pack("<i", len(part)) + part
    flags = codec << 5 | (4 if shuffle == "bits" else 1 if shuffle else 0) | (0 if split else 16)
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, at + len(body)) + struct.pack(f"<{len(starts)}i", *starts) + body


@pytest.mark.parametrize("kind", ["blosclz", "lz4", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", [True, False, "bits"])
@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_round_trip(kind, shuffle, width):
    data = (np.random.default_rng(0).integers(0, 40, 3001) ** 2 % 251).astype(f"<u{width}").tobytes() + b"xyz"[: width - 1]
    for split in (True, False):
        assert blosc.decode(packed(data, width, 256 * width, kind, shuffle, split)) == data
    whole = data[: 3000 * width]
    assert blosc.decode(packed(whole, width, len(whole), kind, shuffle, False)) == whole


def test_bits_of_a_block_by_hand():
    """Value i has bit i set alone, so plane k holds a one for value k."""
    values = bytes(1 << i for i in range(8))
    assert blosc.unshuffled_bits(values, 1) == values and blosc.unshuffled_bits(b"\xff" + bytes(7), 1) == b"\x01" * 8
    assert blosc.unshuffled_bits(bytes(8) + b"\x80" + bytes(7), 2) == bytes(14) + b"\x00\x01" and blosc.unshuffled_bits(b"abc", 1) == b"abc"


def test_repeats_by_hand():
    """Literals `ab`, then lengths and distances as the format packs them."""
    assert blosc.blosclz(bytes([1]) + b"ab" + bytes([1 << 5, 1])) == b"ababa"
    assert blosc.blosclz(bytes([0]) + b"a" + bytes([7 << 5, 255, 2, 0])) == b"a" * (1 + 3 + 6 + 255 + 2)
    far = np.random.default_rng(2).bytes(9000)
    text = b"".join(bytes([len(far[k : k + 32]) - 1]) + far[k : k + 32] for k in range(0, 9000, 32))
    assert blosc.blosclz(text + bytes([3 << 5 | 31, 255, 0, 8])) == far + far[9000 - 8200 :][:5]
    with pytest.raises(ValueError, match="before its beginning"):
        blosc.blosclz(bytes([0]) + b"a" + bytes([1 << 5, 9]))


def test_noise_is_stored_as_it_is():
    data = np.random.default_rng(1).bytes(5000)
    assert blosc.decode(packed(data, 8, 1024, "lz4", True, True)) == data
    assert blosc.decode(struct.pack("<BBBBIII", 2, 1, 2, 4, 3, 3, 19) + b"abc") == b"abc"


def test_unknown_forms_are_named():
    with pytest.raises(ValueError, match="codec 6"):
        blosc.decode(struct.pack("<BBBBIII", 2, 1, 6 << 5, 1, 8, 8, 30) + struct.pack("<ii", 20, 3) + b"abc")
    with pytest.raises(ValueError, match="has 3 bytes, not 8"):
        blosc.decode(struct.pack("<BBBBIII", 2, 1, 16, 1, 8, 8, 28) + struct.pack("<ii", 20, 4) + b"\x02abc")


@pytest.mark.parametrize("kind, shuffle, width", [("lz4", True, 2), ("blosclz", "bits", 1), ("zstd", "bits", 2)])
def test_volume_of_blosc_chunks(spark, tmp_path, kind, shuffle, width):
    ngff.register(spark)
    data = (np.arange(6 * 8 * 8) % 200).astype(f"<u{width}").reshape(6, 8, 8)
    path = tmp_path / "b.zarr"
    path.mkdir()
    (path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [6, 8, 8], "chunks": [3, 8, 8], "dtype": data.dtype.str, "compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1}, "fill_value": 0, "order": "C", "filters": None}))
    for z in range(2):
        (path / f"{z}.0.0").write_bytes(packed(data[3 * z : 3 * z + 3].tobytes(), width, 128 * width, kind, shuffle, True))
    got = spark.read.format("ngff").options(path=str(path)).load().orderBy("cz").collect()
    np.testing.assert_array_equal(np.concatenate([r["data"] for r in got]), data.ravel())
