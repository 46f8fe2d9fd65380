"""Vectors from texts and images by models that the user brings.

A text model is a table of token vectors with a function from text to token
numbers; an image model is an ONNX file with a decoder from bytes to pixels.
Both are loaded once per executor process and run on Arrow batches.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of image preparation: sizes and the mean and spread of each colour.
SHORT_EDGE, CROP = 256, 224
MEAN, SPREAD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def models_dir(folder: str | None = None) -> str:
    return folder or os.environ.get("SIMLOOM_MODELS_DIR", "models")


def read_safetensors(data: bytes, name: str = "embeddings") -> np.ndarray:
    """A float32 matrix of a safetensors file."""
    size = int.from_bytes(data[:8], "little")
    entry = json.loads(data[8 : 8 + size]).get(name)
    if entry is None or entry["dtype"] != "F32" or len(entry["shape"]) != 2:
        raise ValueError(f"no float32 matrix {name}")
    start, end = (8 + size + x for x in entry["data_offsets"])
    if end - start != 4 * entry["shape"][0] * entry["shape"][1]:
        raise ValueError(f"{name} has a wrong size")
    return np.frombuffer(data[start:end], "<f4").reshape(entry["shape"])


@dataclass(frozen=True)
class TextModel:
    """Mean of the vectors of a text's tokens, to length one if ``normalize``."""

    vectors: np.ndarray
    tokenize: Callable[[str], list[int]]
    normalize: bool = True

    def embed(self, text: str) -> np.ndarray | None:
        """None of a text without known tokens."""
        ids = [i for i in self.tokenize(text) if i < len(self.vectors)]
        if not ids:
            return None
        v = self.vectors[ids].astype(np.float32).mean(axis=0, dtype=np.float32)
        length = np.sqrt((v * v).sum())
        return v / length if self.normalize and length > 0 else v


def load_text_model(folder: str) -> TextModel:
    """``tokenizer.json``, ``model.safetensors`` and ``config.json`` of a folder."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
    with open(f"{folder}/model.safetensors", "rb") as f:
        vectors = read_safetensors(f.read())
    normalize = True
    if os.path.exists(f"{folder}/config.json"):
        with open(f"{folder}/config.json", encoding="utf-8") as f:
            normalize = json.load(f).get("normalize", True)
    return TextModel(vectors, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, normalize)


def embed_text(text: Column | str, load: Callable[[], TextModel]) -> Column:
    """The vectors of a text column; null of texts without known tokens."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            found = [None if t is None else model.embed(t) for t in s]
            yield pd.Series([None if v is None else v.tolist() for v in found], dtype="object")

    return F.pandas_udf(run, "array<float>")(text)


def shipped_text_model(spark: SparkSession, folder: str) -> Callable[[], TextModel]:
    """The folder's model, sent to every executor once with ``addFile``; call inside tasks."""
    spark.sparkContext.addFile(folder, recursive=True)
    name = os.path.basename(folder.rstrip("/"))

    def load() -> TextModel:
        from pyspark import SparkFiles

        return cached_text_model(SparkFiles.get(name))

    return load


@lru_cache(4)
def cached_text_model(folder: str) -> TextModel:
    return load_text_model(folder)


def text_model_from_bytes(vectors: bytes, tokenizer: bytes, config: bytes | None = None) -> TextModel:
    """A model from the contents of its three files."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_buffer(tokenizer)
    return TextModel(read_safetensors(vectors), lambda t: tokens.encode(t, add_special_tokens=False).ids, True if config is None else json.loads(config).get("normalize", True))


def read_png(data: bytes) -> np.ndarray:
    """RGB pixels of a PNG file of eight bits a channel without interlacing; grey becomes three channels, alpha goes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a damaged PNG file")
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9]) if head else None
    if channels is None or head[8] != 8 or head[12]:
        raise ValueError("a PNG form that isn't read")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    above, rows = np.zeros((width, channels), np.int64), []
    for line in raw:
        row = line[1:].reshape(width, channels).astype(np.int64)
        if line[0] == 1:
            row = np.cumsum(row, axis=0) & 255
        elif line[0] == 2:
            row = (row + above) & 255
        elif line[0] in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                if line[0] == 3:
                    guess = (left + up) >> 1
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x] = left = (row[x] + guess) & 255
                corner = up
        rows.append(row)
        above = row
    pixels = np.stack(rows).astype(np.uint8) if rows else np.zeros((0, width, channels), np.uint8)
    if head[9] == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def read_image(data: bytes) -> np.ndarray:
    """RGB pixels of an image file: PNG here, others where an image library is installed."""
    if data[:4] == b"\x89PNG":
        return read_png(data)
    try:
        from PIL import Image
    except ModuleNotFoundError as e:
        raise ValueError("only PNG files are read without an image library") from e
    import io

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _weights(size: int, target: int) -> np.ndarray:
    """Catmull-Rom weights of a line's pixels for each of the target's; wider where it shrinks."""
    scale = max(size / target, 1.0)
    x = np.abs((np.arange(size) + 0.5)[None] - ((np.arange(target) + 0.5) * size / target)[:, None]) / scale
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def cropped(pixels: np.ndarray) -> np.ndarray:
    """The short edge scaled to 256, then the centre of 224 by 224."""
    height, width = pixels.shape[:2]
    w, h, left, top = crop_box(width, height)
    x = np.einsum("th,hwc->twc", _weights(height, h)[top : top + CROP], pixels.astype(np.float64))
    x = np.einsum("sw,twc->tsc", _weights(width, w)[left : left + CROP], x)
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def prepared_image(data: bytes) -> np.ndarray:
    return cropped(read_image(data))


def crop_box(width: int, height: int) -> tuple[int, int, int, int]:
    """Size after scaling the short edge, and the corner of the centre crop."""
    scale = SHORT_EDGE / min(width, height)
    w, h = max(CROP, round(width * scale)), max(CROP, round(height * scale))
    return w, h, (w - CROP) // 2, (h - CROP) // 2


def image_tensor(pixels: np.ndarray) -> np.ndarray:
    """A cropped RGB image of bytes to the model's input: colours first, standardised."""
    x = pixels.astype(np.float32) / np.float32(255)
    x = (x - np.array(MEAN, np.float32)) / np.array(SPREAD, np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1))[None]


def embed_image(content: Column | str, decode: Callable[[bytes], np.ndarray] | None, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Column:
    """The vectors of image files.

    ``decode`` gives the cropped RGB pixels of a file's bytes (by default
    ``prepared_image``), ``load`` the model as a function of the tensor; results
    are brought to length one.
    """
    decode = decode or prepared_image

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            out = []
            for data in s:
                if data is None:
                    out.append(None)
                    continue
                v = np.asarray(model(image_tensor(decode(bytes(data)))), np.float32).ravel()
                length = np.sqrt((v * v).sum())
                out.append((v / length if length > 0 else v).tolist())
            yield pd.Series(out, dtype="object")

    return F.pandas_udf(run, "array<float>")(content)


@lru_cache(4)
def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})[0]
