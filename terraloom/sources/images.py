"""Image folders, decoders as a plug-in, and an executor-local cache of decoded images."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THUMBNAIL_SCALE = 50.0  # of the square root of the area


class Decoder(Protocol):
    """Bytes of an image file to (rows, cols, 3) of 8-bit BGR, or None where they are none."""

    def __call__(self, content: bytes) -> np.ndarray | None: ...


def list_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified), in the order of paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def decoded(spark: SparkSession, folder: str, decoder: Decoder, pattern: str = "*") -> DataFrame:
    """(path, width_px, height_px, thumbnail): images that the decoder reads; the others are dropped. The thumbnail is its raw BGR bytes,
    reduced by area to about THUMBNAIL_SCALE squared pixels, with its size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                image = decoder(bytes(content))
                if image is None:
                    continue
                t = shrink(image, max(1, int(np.sqrt(image.shape[0] * image.shape[1]) // THUMBNAIL_SCALE)))
                rows.append((path, image.shape[1], image.shape[0], t.shape[1], t.shape[0], t.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width_px", "height_px", "thumb_cols", "thumb_rows", "thumbnail"])

    return files.mapInPandas(run, "path string, width_px int, height_px int, thumb_cols int, thumb_rows int, thumbnail binary")


def shrink(image: np.ndarray, factor: int) -> np.ndarray:
    """Mean of blocks of ``factor`` by ``factor`` pixels; an incomplete last row or column of blocks is left out unless it is the only one."""
    if factor <= 1:
        return image
    h, w = max(1, image.shape[0] // factor), max(1, image.shape[1] // factor)
    part = image[: h * factor, : w * factor].astype(float)
    fh, fw = part.shape[0] // h, part.shape[1] // w
    return part[: h * fh, : w * fw].reshape(h, fh, w, fw, -1).mean((1, 3))


class ImageCache:
    """Keeps the images used last. Threads that ask for one image at a time wait for a single load of it."""

    def __init__(self, load: Callable[[str], object], capacity: int):
        self._load, self._capacity = load, capacity
        self._held: OrderedDict[str, object] = OrderedDict()
        self._busy: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self.loads = 0

    def get(self, key: str):
        while True:
            with self._lock:
                if key in self._held:
                    self._held.move_to_end(key)
                    return self._held[key]
                wait = self._busy.get(key)
                if wait is None:
                    self._busy[key] = threading.Event()
                    break
            wait.wait()
        try:
            value = self._load(key)
            with self._lock:
                self.loads += 1
                self._held[key] = value
                while len(self._held) > self._capacity:
                    self._held.popitem(last=False)
            return value
        finally:
            with self._lock:
                self._busy.pop(key).set()
