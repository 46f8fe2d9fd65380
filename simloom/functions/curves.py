"""Codes on space-filling curves, for many points at once.

A code is kept as an array of its bits, highest first, so 128 bits need no
wide integers; ``to_bytes`` packs them.
"""

from __future__ import annotations

import numpy as np


def quantised(vectors: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """The first ``dims`` components from [-1, 1] to integers, halves up, held in range."""
    most = np.float32((1 << bits) - 1)
    scaled = (vectors[:, :dims].astype(np.float32) + np.float32(1)) / np.float32(2) * most
    return np.clip(np.floor(scaled.astype(np.float64) + 0.5), 0, float(most)).astype(np.int64)


def _planes(coords: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each point by level, highest first, then by dimension."""
    levels = np.arange(bits - 1, -1, -1)
    return (coords[:, None, :] >> levels[None, :, None]) & 1


def _points(planes: np.ndarray) -> np.ndarray:
    weights = 1 << np.arange(planes.shape[1] - 1, -1, -1)
    return (planes * weights[None, :, None]).sum(axis=1)


def morton_bits(coords: np.ndarray, bits: int) -> np.ndarray:
    """Bits of all dimensions in turn; dimension 0 is the lowest of its level."""
    return _planes(coords, bits)[:, :, ::-1].reshape(len(coords), -1)


def morton_points(code: np.ndarray, dims: int, bits: int) -> np.ndarray:
    return _points(code.reshape(len(code), bits, dims)[:, :, ::-1])


class _Turns:
    """Orientation of the curve at a level, of each point."""

    def __init__(self, rows: int, dims: int):
        self.dims, self.rotation, self.reflection = dims, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.mask = (1 << dims) - 1

    def rotate(self, point: np.ndarray, back: bool = False) -> np.ndarray:
        turn = self.rotation % self.dims
        there, rest = (self.dims - turn, turn) if back else (turn, self.dims - turn)
        turned = ((point << there) | (point >> rest)) & self.mask
        return np.where(self.rotation == 0, point, turned)

    def update(self, placed: np.ndarray) -> None:
        gray = placed ^ (placed >> 1)
        if self.dims == 2:
            step = np.select([gray == 0, gray == 3], [1, 3], 0)
            self.rotation = (self.rotation + step) % 4
            self.reflection ^= np.where(step > 0, 3, 0)
            return
        lowest = gray & -gray
        zeros = np.where(gray == 0, 32, np.log2(np.maximum(lowest, 1)).astype(np.int64))
        self.rotation = (self.rotation + zeros) % self.dims
        self.reflection ^= np.where(gray & 1 == 0, np.int64(1) << (zeros % self.dims), 0)


def hilbert_bits(coords: np.ndarray, bits: int) -> np.ndarray:
    """Levels from the highest, each turned as the levels above say.

    Exact turns in two dimensions; in others a simpler rule that can be undone
    but isn't a true Hilbert curve.
    """
    dims, out = coords.shape[1], []
    places = np.arange(dims)
    turns = _Turns(len(coords), dims)
    for level in np.moveaxis(_planes(coords, bits), 1, 0):
        placed = turns.rotate((level << places).sum(axis=1)) ^ turns.reflection
        out.append((placed[:, None] >> places) & 1)
        turns.update(placed)
    return np.concatenate(out, axis=1) if out else np.zeros((len(coords), 0), np.int64)


def hilbert_points(code: np.ndarray, dims: int, bits: int) -> np.ndarray:
    places, planes = np.arange(dims), []
    turns = _Turns(len(code), dims)
    for level in np.moveaxis(code.reshape(len(code), bits, dims), 1, 0):
        placed = (level << places).sum(axis=1)
        planes.append((turns.rotate(placed ^ turns.reflection, back=True)[:, None] >> places) & 1)
        turns.update(placed)
    return _points(np.stack(planes, axis=1))


def to_bytes(code: np.ndarray) -> np.ndarray:
    """Bits to whole bytes, zeros in front; shape (rows, bytes)."""
    pad = -code.shape[1] % 8
    return np.packbits(np.pad(code, ((0, 0), (pad, 0))).astype(np.uint8), axis=1)


def from_bytes(data: np.ndarray, n_bits: int) -> np.ndarray:
    return np.unpackbits(data, axis=1)[:, -n_bits:].astype(np.int64) if n_bits else np.zeros((len(data), 0), np.int64)


def to_ints(code: np.ndarray) -> list[int]:
    return [int.from_bytes(r.tobytes(), "big") for r in to_bytes(code)]


def from_ints(values: list[int], n_bits: int) -> np.ndarray:
    size = -(-n_bits // 8)
    raw = np.frombuffer(b"".join(v.to_bytes(size, "big") for v in values), np.uint8).reshape(-1, size)
    return from_bytes(raw, n_bits)
