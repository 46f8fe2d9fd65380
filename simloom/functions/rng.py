"""Random projections that are the same everywhere.

A row of a projection matrix is a stream of normal deviates: a BLAKE3 digest of
the seed and the row's place keys a ChaCha20 stream, whose 64-bit words feed a
256-layer ziggurat.  Rows are made once on the driver, cached, and travel to
executors inside the functions that use them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_M = 0xFFFFFFFF
#: Fixed values of BLAKE3: initial words and the order in which a round takes the message.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_ONE_BLOCK = 1 | 2 | 8  # first and last of its chunk, and the root
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
#: Fixed values of the ziggurat: layers and the start of the tail.
LAYERS, TAIL = 256, 3.654152885361009
COMMON_SOURCE_DIMS = 2048


def blake3_short(data: bytes) -> bytes:
    """BLAKE3 digest of at most 64 bytes."""
    if len(data) > 64:
        raise ValueError("one block only")
    block = data.ljust(64, b"\0")
    words = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*_IV, *_IV[:4], 0, 0, len(data), _ONE_BLOCK]
    right = lambda x, n: ((x >> n) | (x << (32 - n))) & _M
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for m, (r1, r2) in zip(words[2 * k : 2 * k + 2], ((16, 12), (8, 7)), strict=True):
                v[a] = (v[a] + v[b] + m) & _M
                v[d] = right(v[d] ^ v[a], r1)
                v[c] = (v[c] + v[d]) & _M
                v[b] = right(v[b] ^ v[c], r2)
        words = [words[i] for i in _ORDER]
    return b"".join((v[i] ^ v[i + 8]).to_bytes(4, "little") for i in range(8))


def chacha20_words(key: bytes, n: int) -> np.ndarray:
    """The first ``n`` 64-bit words of a ChaCha20 stream with a 64-bit counter from 0."""
    blocks = -(-n // 8)
    start = np.zeros((16, blocks), np.uint32)
    start[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    start[4:12] = np.frombuffer(key, "<u4")[:, None]
    counter = np.arange(blocks, dtype=np.uint64)
    start[12], start[13] = (counter & _M).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    x = start.copy()
    left = lambda v, k: (v << np.uint32(k)) | (v >> np.uint32(32 - k))
    for _ in range(10):
        for a, b, c, d in _LANES:
            for low, turn in ((0, 16), (1, 12), (0, 8), (1, 7)):
                if low == 0:
                    x[a] += x[b]
                    x[d] = left(x[d] ^ x[a], turn)
                else:
                    x[c] += x[d]
                    x[b] = left(x[b] ^ x[c], turn)
    return np.ascontiguousarray((x + start).T).view("<u8").ravel()[:n]


@lru_cache(1)
def _layers() -> tuple[list[float], list[float]]:
    """Widths and heights of layers of equal area under exp(-x^2 / 2)."""
    density = lambda x: math.exp(-x * x / 2)
    area = TAIL * density(TAIL) + math.sqrt(math.pi / 2) * math.erfc(TAIL / math.sqrt(2))
    x = [area / density(TAIL), TAIL]
    while len(x) < LAYERS:
        x.append(math.sqrt(-2 * math.log(area / x[-1] + density(x[-1]))))
    x.append(0.0)
    return x, [density(v) for v in x]


def normals(key: bytes, n: int) -> np.ndarray:
    """``n`` standard normal deviates as float32."""
    width, height = _layers()
    words = chacha20_words(key, n + n // 8 + 64).tolist()
    at, out = 0, []

    def word() -> int:
        nonlocal words, at
        if at == len(words):
            words = chacha20_words(key, 2 * len(words)).tolist()
        at += 1
        return words[at - 1]

    while len(out) < n:
        bits = word()
        layer = bits & 0xFF
        u = (bits >> 12) * 2.0**-51 - 1.0
        x = u * width[layer]
        if abs(x) < width[layer + 1]:
            out.append(x)
        elif layer == 0:
            a, b = 1.0, 0.0
            while -2.0 * b < a * a:
                a = math.log((word() >> 12) * 2.0**-52 + 2.0**-53) / TAIL
                b = math.log((word() >> 12) * 2.0**-52 + 2.0**-53)
            out.append(a - TAIL if u < 0 else TAIL - a)
        elif height[layer + 1] + (height[layer] - height[layer + 1]) * ((word() >> 11) * 2.0**-53) < math.exp(-x * x / 2):
            out.append(x)
    return np.array(out, np.float64).astype(np.float32)


@lru_cache(16)
def hyperplanes(seed: int, dims: int) -> np.ndarray:
    """128 rows of ``dims`` deviates; fewer dims give a prefix of each row."""
    low = (seed & (1 << 64) - 1).to_bytes(8, "little")
    return np.stack([normals(blake3_short(low + bytes([bit])), dims) for bit in range(128)]) if dims else np.zeros((128, 0), np.float32)


@lru_cache(16)
def projection(seed: int, source: int, target: int) -> np.ndarray:
    """``target`` rows of ``source`` deviates, scaled by one over the root of ``target``."""
    head = (seed & (1 << 64) - 1).to_bytes(8, "little") + source.to_bytes(2, "little") + target.to_bytes(2, "little")
    scale = np.float32(1) / np.sqrt(np.float32(target))
    return np.stack([normals(blake3_short(head + row.to_bytes(2, "little")), source) * scale for row in range(target)])


def sequential_dot(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dot products of float32 vectors with rows, summed in order of the components."""
    total = np.zeros((len(vectors), len(rows)), np.float32)
    for j in range(vectors.shape[1]):
        total += vectors[:, j : j + 1] * rows[:, j]
    return total
