"""Vectors as bytes and back, many at once: projection, quantisation, payloads.

All sums are of float32 in order of the components, so results don't depend on
the machine.
"""

from __future__ import annotations

import numpy as np

from simloom.functions import rng
from simloom.functions.profiles import FULL_HEADER, TYPE_FULL, Dimensions, FullProfile, Header, Precision, read_header


def projected(vectors: np.ndarray, dimensions: Dimensions, seed: int) -> np.ndarray:
    """To fewer dimensions, or to a space common to vectors of any size."""
    if dimensions.mode == "preserve":
        return vectors
    dims = vectors.shape[1]
    if dimensions.mode == "common":  # as if padded with zeros, which add nothing
        rows = rng.projection(seed, rng.COMMON_SOURCE_DIMS, dimensions.target)[:, :dims]
    else:
        if dimensions.target > dims:
            raise ValueError(f"cannot project {dims} dimensions to {dimensions.target}")
        rows = rng.projection(seed, dims, dimensions.target)
    return rng.sequential_dot(vectors.astype(np.float32), rows)


def quantised(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers from 0 to 2**bits - 1 over each row's range, and the ranges' ends; constant rows give the middle."""
    values = values.astype(np.float32)
    low, high = values.min(axis=1), values.max(axis=1)
    span = high - low
    most = np.float32((1 << bits) - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = (values - low[:, None]) / span[:, None] * most
    q = np.clip(np.floor(scaled.astype(np.float64) + 0.5), 0, float(most))
    q = np.where(span[:, None] == 0, (1 << bits) // 2, np.minimum(np.nan_to_num(q), (1 << bits) - 1))
    return q.astype(np.int64), low, high


def restored(q: np.ndarray, bits: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    span = (high - low).astype(np.float32)
    share = q.astype(np.float32) / np.float32((1 << bits) - 1)
    return np.where(span[:, None] == 0, low[:, None], low[:, None] + share * span[:, None]).astype(np.float32)


def payloads(values: np.ndarray, precision: Precision) -> list[bytes]:
    """Big-endian floats, or the range's ends and packed integers, highest bits first."""
    if precision.kind == "full32":
        return [r.tobytes() for r in values.astype(">f4")]
    if precision.kind == "half16":
        with np.errstate(over="ignore"):
            return [r.tobytes() for r in values.astype(">f2")]
    q, low, high = quantised(values, precision.bits)
    shifts = np.arange(precision.bits - 1, -1, -1)
    packed = np.packbits(((q[:, :, None] >> shifts) & 1).reshape(len(q), -1).astype(np.uint8), axis=1)
    ends = np.stack([low, high], axis=1).astype(">f4")
    return [e.tobytes() + p.tobytes() for e, p in zip(ends, packed, strict=True)]


def vector_of(payload: bytes, precision: Precision, dims: int) -> np.ndarray | None:
    """None where the payload can't be one; a short one of packed integers gives what it holds."""
    if precision.kind in ("full32", "half16"):
        kind = ">f4" if precision.kind == "full32" else ">f2"
        return np.frombuffer(payload, kind).astype(np.float32) if len(payload) % (precision.bits // 8) == 0 else None
    if len(payload) < 8:
        return None
    low, high = np.frombuffer(payload[:8], ">f4").astype(np.float32)
    n = len(payload) - 8 if precision.kind == "quant8" else min(dims, (len(payload) - 8) * 8 // precision.bits)
    found = np.unpackbits(np.frombuffer(payload[8:], np.uint8))[: n * precision.bits].reshape(n, precision.bits).astype(np.int64)
    q = (found << np.arange(precision.bits - 1, -1, -1)).sum(axis=1)
    return restored(q[None], precision.bits, np.array([low]), np.array([high]))[0]


def encoded(vectors: np.ndarray, profile: FullProfile) -> list[bytes]:
    """Header and payload of vectors of one size, not normalised."""
    dims = vectors.shape[1]
    profile.dimensions.check(dims)
    head = profile.header(dims)
    return [head + p for p in payloads(projected(vectors, profile.dimensions, profile.seed), profile.precision)]


def decoded(data: bytes | None) -> np.ndarray | None:
    """The stored vector, in the space it was stored in; None if there is none."""
    head = read_header(data) if data is not None else None
    if head is None or head.type_id != TYPE_FULL:
        return None
    return vector_of(data[FULL_HEADER:], head.precision, head.dimensions.output(head.original_dims))


def metadata(data: bytes | None) -> dict | None:
    head = read_header(data) if data is not None else None
    if head is None or head.type_id != TYPE_FULL:
        return None
    return described(head)


def described(head: Header) -> dict:
    stored = head.dimensions.output(head.original_dims)
    return {
        "original_dims": head.original_dims,
        "encoded_dims": stored,
        "is_lossless": head.precision.kind == "full32" and head.dimensions.mode == "preserve",
        "has_dimension_reduction": stored < head.original_dims,
        "precision": head.precision.kind,
        "precision_bits": head.precision.bits if head.precision.kind == "bits" else None,
        "dimension_mode": head.dimensions.mode,
    }
