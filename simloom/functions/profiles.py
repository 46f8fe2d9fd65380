"""How vectors become IDs: profiles, their sizes and their headers.

An ID is base32hex of a header and a payload.  Sortable profiles have a header
of two bytes, optionally followed by a transform number; the reversible full
vector has one of twelve.  Profiles are checked when a plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Default seeds of the profiles, type numbers, bounds of vectors.
SEED_HASH = 0x454C494453494D48
SEED_LOSSLESS = 0x454C494446554C4C
SEED_COMPRESSED = 0x454C4944434F4D50
SEED_MAX_LENGTH = 0x454C49444D41584C
SEED_COMMON = 0x454C494458444949
TYPE_HASH, TYPE_MORTON, TYPE_HILBERT, TYPE_FULL = 1, 2, 3, 4
MIN_DIMS, MAX_DIMS = 64, 2048
MAX_CODE_DIMS, MAX_CODE_BITS, MAX_CODE = 32, 16, 128
FULL_HEADER, SHORT_HEADER = 12, 2
ASSUMED_DIMS = 768


@dataclass(frozen=True)
class Precision:
    """Bits of a stored component: 32 or 16 as floats, 8 or any other number quantised."""

    kind: str  # full32, half16, quant8 or bits
    bits: int = 0

    def __post_init__(self) -> None:
        fixed = {"full32": 32, "half16": 16, "quant8": 8}
        if self.kind in fixed:
            object.__setattr__(self, "bits", fixed[self.kind])
        elif self.kind != "bits" or not 1 <= self.bits <= 32:
            raise ValueError(f"precision {self.kind} of {self.bits} bits")

    @property
    def bits_per_dim(self) -> int:
        return self.bits

    @property
    def code(self) -> int:
        return {"full32": 0, "half16": 1, "quant8": 2}.get(self.kind, 2 + self.bits)

    @staticmethod
    def from_code(code: int) -> Precision | None:
        if code < 3:
            return (FULL32, HALF16, QUANT8)[code]
        return Precision("bits", code - 2) if code <= 34 else None

    def payload_bytes(self, dims: int) -> int:
        if self.kind in ("full32", "half16"):
            return dims * self.bits // 8
        return 8 + -(-dims * self.bits // 8)


FULL32, HALF16, QUANT8 = Precision("full32"), Precision("half16"), Precision("quant8")


def bits(n: int) -> Precision:
    return Precision("bits", n)


@dataclass(frozen=True)
class Dimensions:
    """All of them, fewer by projection, or a space common to vectors of any size."""

    mode: str = "preserve"  # preserve, reduce or common
    target: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("preserve", "reduce", "common"):
            raise ValueError(f"dimension mode {self.mode}")
        if self.mode != "preserve" and self.target <= 0:
            raise ValueError("target dimensions must be positive")
        if self.mode == "common" and self.target > MAX_DIMS:
            raise ValueError(f"a common space has at most {MAX_DIMS} dimensions")

    @property
    def code(self) -> int:
        return ("preserve", "reduce", "common").index(self.mode)

    def output(self, dims: int) -> int:
        return dims if self.mode == "preserve" else self.target

    def check(self, dims: int) -> None:
        if self.mode == "reduce" and not 0 < self.target < dims:
            raise ValueError(f"cannot reduce {dims} dimensions to {self.target}")


PRESERVE = Dimensions()


def reduce_to(target: int) -> Dimensions:
    return Dimensions("reduce", target)


def common(target: int) -> Dimensions:
    return Dimensions("common", target)


class Profile:
    type_id = 0

    @property
    def reversible(self) -> bool:
        return self.type_id == TYPE_FULL

    def bit_length(self, dims: int = ASSUMED_DIMS) -> int:
        raise NotImplementedError

    def string_length(self, dims: int = ASSUMED_DIMS) -> int:
        """Characters of an ID, without the range that quantised payloads carry."""
        return -(-(self.bit_length(dims) + 8 * (FULL_HEADER if self.reversible else SHORT_HEADER)) // 5)


@dataclass(frozen=True)
class HashProfile(Profile):
    """128 signs of random projections."""

    seed: int = SEED_HASH
    type_id = TYPE_HASH

    def bit_length(self, dims: int = ASSUMED_DIMS) -> int:
        return 128

    def header(self, dims: int) -> bytes:
        return bytes([self.type_id, 0])


@dataclass(frozen=True)
class CurveProfile(Profile):
    """A code on a space-filling curve of the first ``dims`` components."""

    dims: int = 10
    bits_per_dim: int = 10
    transform: int | None = None

    def __post_init__(self) -> None:
        if self.transform is not None:
            raise ValueError(f"transform {self.transform} is not known")
        if not 1 <= self.dims <= MAX_CODE_DIMS or not 1 <= self.bits_per_dim <= MAX_CODE_BITS:
            raise ValueError("curves have 1 to 32 dimensions of 1 to 16 bits")
        if self.dims * self.bits_per_dim > MAX_CODE:
            raise ValueError("curve codes have at most 128 bits")

    def bit_length(self, dims: int = ASSUMED_DIMS) -> int:
        return self.dims * self.bits_per_dim

    def header(self, dims: int) -> bytes:
        return bytes([self.type_id, 0])


@dataclass(frozen=True)
class MortonProfile(CurveProfile):
    type_id = TYPE_MORTON


@dataclass(frozen=True)
class HilbertProfile(CurveProfile):
    type_id = TYPE_HILBERT


@dataclass(frozen=True)
class FullProfile(Profile):
    """The vector itself at some precision; can be decoded."""

    precision: Precision = FULL32
    dimensions: Dimensions = field(default_factory=Dimensions)
    seed: int = SEED_LOSSLESS
    type_id = TYPE_FULL

    def bit_length(self, dims: int = ASSUMED_DIMS) -> int:
        return self.dimensions.output(dims) * self.precision.bits_per_dim

    def header(self, dims: int) -> bytes:
        low = (self.seed & 0xFFFFFFFF).to_bytes(4, "big")
        target = 0 if self.dimensions.mode == "preserve" else self.dimensions.target
        return bytes([self.type_id, 0]) + dims.to_bytes(2, "big") + bytes([self.precision.code, self.dimensions.code]) + target.to_bytes(2, "big") + low


def default_profile() -> Profile:
    return HashProfile()


def lossless() -> FullProfile:
    return FullProfile()


def _half_up(x: float) -> int:
    return int(np.floor(x + np.float32(0.5)))


def compressed(retention: float, dims: int) -> FullProfile:
    """Keep about that share of the bits: fewer dimensions first, down to a quarter, then fewer bits."""
    kept = np.float32(32) * np.float32(dims) * min(max(np.float32(retention), np.float32(0.01)), np.float32(1))
    for precision in (FULL32, HALF16, QUANT8):
        target = min(_half_up(kept / np.float32(precision.bits)), 0xFFFF)
        if precision is FULL32 and target >= dims:
            return lossless()
        if target >= dims // 4 or precision is QUANT8:
            break
    return FullProfile(precision, PRESERVE if target >= dims else reduce_to(max(1, target)), SEED_COMPRESSED)


def max_length(chars: int, dims: int, strict: bool = False) -> FullProfile:
    """The finest precision that keeps 16 dimensions within so many characters.

    By itself this doesn't count the 64 bits of range that quantised payloads
    carry; ``strict`` does.
    """
    room = max(0, chars - 20) * 5
    if strict:
        return _strict_length(chars, dims)
    if room == 0:
        return FullProfile(bits(1), reduce_to(1), SEED_MAX_LENGTH)
    if room // dims >= 32:
        return lossless()
    for precision in (FULL32, HALF16, QUANT8, bits(4), bits(2), bits(1)):
        fit = room // precision.bits
        if fit >= 16 or fit >= dims:
            return FullProfile(precision, PRESERVE if fit >= dims else reduce_to(fit), SEED_MAX_LENGTH)
    return FullProfile(bits(1), reduce_to(max(1, room)), SEED_MAX_LENGTH)


def _strict_length(chars: int, dims: int) -> FullProfile:
    room = chars * 5 // 8 - FULL_HEADER
    for precision in (FULL32, HALF16, QUANT8, bits(4), bits(2), bits(1)):
        free = room - (8 if precision.kind in ("quant8", "bits") else 0)
        fit = max(0, free) * 8 // precision.bits
        if fit >= dims:
            return lossless() if precision is FULL32 else FullProfile(precision, PRESERVE, SEED_MAX_LENGTH)
        if fit >= 16 or (precision.bits == 1 and fit > 0):
            return FullProfile(precision, reduce_to(fit), SEED_MAX_LENGTH)
    raise ValueError(f"no vector fits in {chars} characters")


def cross_dimensional(target: int, precision: Precision = HALF16) -> FullProfile:
    return FullProfile(precision, common(target), SEED_COMMON)


@dataclass(frozen=True)
class Header:
    """What an ID says about itself; fields of the full vector are None for others."""

    version: int
    type_id: int
    transform: int | None = None
    original_dims: int | None = None
    precision: Precision | None = None
    dimensions: Dimensions | None = None
    seed_low: int | None = None

    def pack(self) -> bytes:
        if self.type_id == TYPE_FULL:
            head = FullProfile(self.precision, self.dimensions, self.seed_low or 0).header(self.original_dims)
        else:
            head = bytes([0, 0]) + (b"" if self.transform is None else self.transform.to_bytes(2, "big"))
        return bytes([self.version << 4 | self.type_id]) + head[1:]


def read_header(data: bytes) -> Header | None:
    """None where it isn't a header."""
    if len(data) < SHORT_HEADER:
        return None
    version, type_id = data[0] >> 4, data[0] & 15
    if type_id != TYPE_FULL:
        return Header(version, type_id, int.from_bytes(data[2:4], "big") if len(data) >= 4 else None) if 1 <= type_id <= 3 else None
    if len(data) < FULL_HEADER or data[5] > 2:
        return None
    precision = Precision.from_code(data[4])
    target = int.from_bytes(data[6:8], "big")
    if precision is None or (data[5] and not target) or (data[5] == 2 and target > MAX_DIMS):
        return None
    mode = Dimensions(("preserve", "reduce", "common")[data[5]], target if data[5] else 0)
    return Header(version, type_id, None, int.from_bytes(data[2:4], "big"), precision, mode, int.from_bytes(data[8:12], "big"))
