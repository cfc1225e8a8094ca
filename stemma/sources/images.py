"""Images brought down to a longest edge on a white ground (S24), in Arrow batches.

PNG is read and written here (8 bits a channel, all colour types, not interlaced); other formats, and JPEG of quality 85 as
output, need an installed imaging library, which is used where there is one."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

try:
    from PIL import Image
except ImportError:  # optional
    Image = None

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels by the format's colour types.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ROWS = "width int, height int, old_width int, old_height int, format string, data binary"


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG without their filters: each line begins with the number of its own."""
    lines = raw[:, 1:].astype(np.int32)
    before = np.zeros(lines.shape[1], np.int32)
    for y, kind in enumerate(raw[:, 0]):
        line = lines[y]
        if kind == 1:  # from the left: a running sum per channel
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step])
        elif kind == 2:
            line += before
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - step], before[x], before[x - step]) if x >= step else (0, before[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        line &= 255
        before = line
    return lines.astype(np.uint8)


def read_png(data: bytes) -> np.ndarray | None:
    """Height x width x 3, transparency laid on white; None for what this reader doesn't know."""
    if not data.startswith(SIGNATURE):
        return None
    packed, palette, clear, head = [], None, None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed.append(body)
    if not head or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        return None
    width, height, kind = head[0], head[1], head[3]
    n = CHANNELS[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * n + 1)
    except (zlib.error, ValueError):
        return None
    x = _unfilter(raw, n).reshape(height, width, n)
    alpha = np.full((height, width, 1), 255.0)
    if kind == 3:
        if palette is None or x.max(initial=0) >= len(palette):
            return None
        if clear is not None:
            alpha = np.concatenate([clear, np.full(256 - len(clear), 255, np.uint8)])[x].astype(float)
        x = palette[x[:, :, 0]]
    elif n in (2, 4):
        x, alpha = x[:, :, :-1], x[:, :, -1:].astype(float)
    rgb = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
    return np.round(rgb * (alpha / 255) + 255 * (1 - alpha / 255)).astype(np.uint8)


def write_png(x: np.ndarray) -> bytes:
    height, width, _ = x.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), x.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _weights(old: int, new: int) -> np.ndarray:
    """new x old: which share of every old pixel lies in a new one."""
    edges = np.arange(new + 1) * old / new
    low, high = np.arange(old)[None, :], np.arange(1, old + 1)[None, :]
    share = np.clip(np.minimum(high, edges[1:, None]) - np.maximum(low, edges[:-1, None]), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def shrink(x: np.ndarray, longest: int) -> np.ndarray:
    """The image with its longest edge brought down to `longest`, each new pixel the mean of the area it covers; smaller
    images stay as they are."""
    height, width, _ = x.shape
    if max(height, width) <= longest:
        return x
    new_h, new_w = (max(1, round(k * longest / max(height, width))) for k in (height, width))
    return np.round(np.einsum("ah,hwc,bw->abc", _weights(height, new_h), x.astype(float), _weights(width, new_w), optimize=True)).astype(np.uint8)


def small_image(data: bytes | None, longest: int = 1024):
    """ROWS of one image; None for null, empty and unreadable data."""
    if not data:
        return None
    x = read_png(bytes(data))
    if x is None and Image is not None:
        try:
            im = Image.open(io.BytesIO(bytes(data))).convert("RGBA")
        except Exception:  # noqa: BLE001 - no image
            return None
        ground = Image.new("RGBA", im.size, (255, 255, 255, 255))
        x = np.asarray(Image.alpha_composite(ground, im).convert("RGB"))
    if x is None:
        return None
    y = shrink(x, longest)
    if Image is not None:
        out = io.BytesIO()
        Image.fromarray(y).save(out, "JPEG", quality=85)
        return y.shape[1], y.shape[0], x.shape[1], x.shape[0], "jpeg", out.getvalue()
    return y.shape[1], y.shape[0], x.shape[1], x.shape[0], "png", write_png(y)


def downscale(images: DataFrame, content: str = "content", longest: int = 1024) -> DataFrame:
    """images with a column image: a struct of ROWS, null where the content is no image that can be read."""
    ship(images.sparkSession)

    @F.pandas_udf(f"image struct<{ROWS.replace(' ', ':').replace(',:', ',')}>".removeprefix("image "))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [small_image(d, longest) for d in s]
        return pd.DataFrame([r or (None,) * 6 for r in rows], columns=[c.split(" ")[0] for c in ROWS.split(", ")])

    out = images.withColumn("image", run(F.col(content)))
    return out.withColumn("image", F.when(F.col("image.data").isNotNull(), F.col("image")))
