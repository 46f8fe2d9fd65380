"""Base32 that sorts like its bytes: digits, then a to v, without padding."""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = re.compile(r"[0-9a-v]*\Z")


def encode(data: bytes) -> str:
    return base64.b32hexencode(data).decode().rstrip("=").lower()


_SYMBOLS = np.frombuffer(b"0123456789abcdefghijklmnopqrstuv", np.uint8)


def encode_rows(data: np.ndarray) -> list[str]:
    """Texts of many byte strings of one length; rows of ``data``."""
    bits = np.unpackbits(data, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 5)))
    codes = np.packbits(bits.reshape(len(bits), -1, 5), axis=2)[:, :, 0] >> 3
    width = codes.shape[1]
    return np.ascontiguousarray(_SYMBOLS[codes]).view(f"S{width}").ravel().astype(f"U{width}").tolist() if width else [""] * len(data)


def decode(text: str) -> bytes | None:
    """None for other characters, impossible lengths or bits beyond the last byte."""
    if not ALPHABET.match(text) or len(text) % 8 in (1, 3, 6):
        return None
    data = base64.b32hexdecode(text.upper() + "=" * (-len(text) % 8))
    return data if encode(data) == text else None


def encode_column(binary: Column, n_bytes: int) -> Column:
    """Built-in expressions for binaries of a fixed length: five bytes are eight characters."""
    whole = F.rpad(F.hex(binary), -(-n_bytes // 5) * 10, "0")
    parts = [F.lpad(F.conv(F.substring(whole, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(-(-n_bytes // 5))]
    return F.substring(F.lower(F.concat(*parts)), 1, -(-n_bytes * 8 // 5))


def is_valid(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike("^[0-9a-v]*$")
