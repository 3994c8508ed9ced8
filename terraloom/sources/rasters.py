"""Raster sinks without foreign codecs: tiled deflate TIFF, PNG, and Parquet tiles."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 512
_FORMAT = {"u": 1, "i": 2, "f": 3}
# Numbers of the TIFF and GeoTIFF tags used here.
_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "samples": 277, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "offsets": 324, "counts": 325, "extra": 338, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113}


def tiff(bands: np.ndarray, transform: tuple[float, float, float] | None = None, nodata: float | None = None, tile: int = TILE) -> bytes:
    """A tiled, deflated TIFF of bands (count, rows, cols). ``transform``: left edge, top edge, cell size. Tiles that hold nothing but the
    no-data value (0 without one) are left out of the file. Whole-number bands are stored as differences between neighbours."""
    bands = np.ascontiguousarray(bands)
    n, h, w = bands.shape
    kind = bands.dtype.newbyteorder("<")
    whole = bands.dtype.kind in "ui"
    empty = (0 if nodata is None else nodata)
    body, offsets, counts = bytearray(), [], []
    rows, cols = -(-h // tile), -(-w // tile)
    for r in range(rows):
        for c in range(cols):
            t = np.full((n, tile, tile), empty, bands.dtype)
            part = bands[:, r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            t[:, : part.shape[1], : part.shape[2]] = part
            if (np.isnan(t).all() if isinstance(empty, float) and np.isnan(empty) else (t == empty).all()):
                offsets.append(0)
                counts.append(0)
                continue
            t = np.moveaxis(t, 0, 2)
            if whole:
                t = np.concatenate([t[:, :1], t[:, 1:] - t[:, :-1]], 1)
            data = zlib.compress(np.ascontiguousarray(t).astype(kind).tobytes(), 6)
            offsets.append(8 + len(body))
            counts.append(len(data))
            body += data + b"\0" * (len(data) % 2)
    entries: list[tuple[int, int, list]] = []  # tag, type (3 short, 4 long, 12 double, 2 text), values
    add = lambda name, kind, *v: entries.append((_TAGS[name], kind, list(v)))
    add("width", 4, w), add("height", 4, h), add("bits", 3, *[bands.dtype.itemsize * 8] * n), add("compression", 3, 8)
    add("photometric", 3, 2 if n >= 3 and bands.dtype == np.uint8 else 1), add("samples", 3, n), add("planar", 3, 1), add("predictor", 3, 2 if whole else 1)
    add("tile_width", 4, tile), add("tile_height", 4, tile), add("offsets", 4, *offsets), add("counts", 4, *counts)
    extra = n - (3 if n >= 3 and bands.dtype == np.uint8 else 1)
    if extra:
        add("extra", 3, *[2] + [0] * (extra - 1))
    add("format", 3, *[_FORMAT[bands.dtype.kind]] * n)
    if transform:
        x, y, size = transform
        add("scale", 12, size, size, 0.0), add("tie", 12, 0.0, 0.0, 0.0, x, y, 0.0), add("keys", 3, 1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1)
    if nodata is not None:
        add("nodata", 2, str(nodata).encode() + b"\0")
    entries.sort(key=lambda e: e[0])
    start = 8 + len(body)
    tail_at = start + 2 + 12 * len(entries) + 4
    directory, tail = struct.pack("<H", len(entries)), b""
    for tag, k, v in entries:
        raw = v[0] if k == 2 else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[k] * len(v), *v)
        size = len(raw) if k == 2 else len(v)
        if len(raw) <= 4:
            directory += struct.pack("<HHI", tag, k, size) + raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<HHII", tag, k, size, tail_at + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, start) + bytes(body) + directory + struct.pack("<I", 0) + tail


def read_tiff(data: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """Bands and tags of a TIFF as :func:`tiff` writes it."""
    order, magic, at = struct.unpack_from("<2sHI", data)
    if order != b"II" or magic != 42:
        raise ValueError("no such TIFF")
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        size = {2: 1, 3: 2, 4: 4, 12: 8}[kind] * n
        place = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from("<I", data, at + 2 + 12 * k + 8)[0]
        tags[tag] = (data[place : place + n],) if kind == 2 else struct.unpack_from("<" + {3: "H", 4: "I", 12: "d"}[kind] * n, data, place)
    w, h, n, t = (tags[_TAGS[x]][0] for x in ("width", "height", "samples", "tile_width"))
    kind = np.dtype(f"<{ {v: k for k, v in _FORMAT.items()}[tags[_TAGS['format']][0]]}{tags[_TAGS['bits']][0] // 8}")
    nodata = float(tags[_TAGS["nodata"]][0].rstrip(b"\0")) if _TAGS["nodata"] in tags else 0
    out = np.full((-(-h // t) * t, -(-w // t) * t, n), nodata).astype(kind)
    cols = -(-w // t)
    for i, (o, c) in enumerate(zip(tags[_TAGS["offsets"]], tags[_TAGS["counts"]])):
        if c:
            part = np.frombuffer(zlib.decompress(data[o : o + c]), kind).reshape(t, t, n)
            if tags[_TAGS["predictor"]][0] == 2:
                part = np.cumsum(part, 1, dtype=kind)
            out[i // cols * t : i // cols * t + t, i % cols * t : i % cols * t + t] = part
    return np.moveaxis(out[:h, :w], 2, 0), tags


def png(image: np.ndarray) -> bytes:
    """PNG of (rows, cols) grey, or (rows, cols, 3 or 4) RGB or RGBA, 8-bit."""
    image = np.atleast_3d(image).astype(np.uint8)
    h, w, n = image.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * n)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def preview(pixels: DataFrame, size: int, most: int = 128) -> str:
    """Base64 PNG of at most ``most`` by ``most`` cells of a tile (row, col, r, g, b, weight): the colour of greatest weight in each; cells
    without a pixel are transparent. At most ``most`` squared rows reach the driver."""
    f = max(1, -(-size // most))
    best = pixels.groupBy(F.floor(F.col("row") / f).alias("i"), F.floor(F.col("col") / f).alias("j")).agg(F.max_by(F.struct("r", "g", "b"), F.struct("weight", -F.col("row"), -F.col("col"))).alias("c"))
    n = -(-size // f)
    out = np.zeros((n, n, 4), np.uint8)
    for x in best.collect():
        out[int(x.i), int(x.j)] = (x.c.r, x.c.g, x.c.b, 255)
    return base64.b64encode(png(out)).decode()


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Layer pixels (tx, ty, …) as Parquet in a folder for each tile; a tile's rows are gathered before they are written."""
    pixels.repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").parquet(path)


def read_tiles(spark: SparkSession, path: str, tx: int | None = None, ty: int | None = None) -> DataFrame:
    """Pixels of all tiles or of one; only that tile's folder is read."""
    df = spark.read.parquet(path)
    for c, v in (("tx", tx), ("ty", ty)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df
