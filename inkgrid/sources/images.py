"""Page images: reading, cutting fields out by box, the checkbox rule on their pixels, and images out: smaller, as PNG, in a grid.

Pixels need Python; a batch of images goes through numpy. All boxes are Columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.config import clamp

# The margin around a cut-out field, and when a box counts as checked.
PAD = 6
DARK, CHECKED_FROM, SURE_FROM = 150, 0.035, 0.12
# A grid's cell, the strip left free below a field, how many cells stand side by side, the margin, the ground;
# the longest side of an image that is sent to a model, as it is by default and at least and at most.
CELL_W, CELL_H, STRIP, ACROSS, GRID_PAD, GROUND = 300, 120, 28, 3, 8, 245
MAX_SIDE, LEAST_SIDE, MOST_SIDE = 900, 320, 1600
#: Channels to PNG's kind of colour.
COLOURS = {1: 0, 3: 2, 4: 6}
#: Weights of blue, green and red in grey.
GREY = np.array([0.114, 0.587, 0.299])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, height, width, channels, data (BGR bytes, row by row); files that are no image have -1 sizes."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    return rows.select(F.col("image.origin").alias("page_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def widened_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, ratio: float = 0.35) -> dict[str, Column]:
    """A pixel box moved outward by whole pixels, inside the image."""
    dx, dy = (w * ratio).cast("int"), (h * ratio).cast("int")
    x1, y1 = F.greatest(F.lit(0), x - dx), F.greatest(F.lit(0), y - dy)
    return {"x": x1, "y": y1, "w": F.least(width, x + w + dx) - x1, "h": F.least(height, y + h + dy) - y1}


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def data_url(content: Column, kind: str = "image/png") -> Column:
    """The bytes of an encoded image as a data URL."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


@F.pandas_udf(T.BinaryType())
def cut_out(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """The pixels of a box with a small margin, as bytes."""
    rows = zip(data, height, width, channels, x, y, w, h)
    return pd.Series([_pixels(d, n, m, c)[max(0, t - PAD) : t + q + PAD, max(0, l - PAD) : l + p + PAD].tobytes() for d, n, m, c, l, t, p, q in rows])


@F.pandas_udf(T.DoubleType())
def dark_share(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """The share of dark pixels in the middle three fifths of an image; null where there are none."""

    def one(d, h, w, c):
        px = _pixels(d, h, w, c)[max(0, h // 5) : min(h, h * 4 // 5), max(0, w // 5) : min(w, w * 4 // 5)]
        if not px.size:
            return None
        grey = np.rint(px[:, :, :3] @ GREY) if c >= 3 else px[:, :, 0]
        return float((grey < DARK).mean())

    return pd.Series([one(*row) for row in zip(data, height, width, channels)])


def checkboxes(images: DataFrame) -> DataFrame:
    """Adds value, normalized_value, confidence, provider and model to images of checkboxes."""
    rows = images.withColumn("dark", dark_share("data", "height", "width", "channels"))
    checked = F.col("dark") > CHECKED_FROM
    return rows.withColumns(
        {
            "value": F.when(F.col("dark").isNull(), "false").when(checked, "checked").otherwise("unchecked"),
            "normalized_value": F.when(checked, "checked").otherwise("false"),
            "confidence": F.when(F.col("dark").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("dark") / SURE_FROM)),
            "provider": F.lit("vision-rule"),
            "model": F.lit("dark-pixel-density"),
        }
    )


def _narrowed(image: np.ndarray, size: int) -> np.ndarray:
    """The image with `size` rows, each the mean of the rows, in whole and in part, that it covers."""
    rows = image.shape[0]
    summed = np.zeros((rows + 1, *image.shape[1:]))
    np.cumsum(image, 0, out=summed[1:])
    edge = np.arange(size + 1) * (rows / size)
    low = np.minimum(edge.astype(int), rows - 1)
    upto = summed[low] + (edge - low)[:, None, None] * image[low]
    return (upto[1:] - upto[:-1]) * (size / rows)


def all_resized(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """Images of one size (n, height, width, channels) at another; a pixel is the mean of the area it covers, halves to even."""
    n, high, wide, channels = images.shape
    down = _narrowed(images.astype(float).transpose(1, 0, 2, 3).reshape(high, n * wide, channels), height)
    made = _narrowed(down.reshape(height, n, wide, channels).transpose(2, 1, 0, 3).reshape(wide, n * height, channels), width)
    return np.clip(np.rint(made.reshape(width, n, height, channels).transpose(1, 2, 0, 3)), 0, 255).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return all_resized(image[None], width, height)[0]


def all_fitted(images: np.ndarray, longest: int) -> np.ndarray:
    """Images of one size made smaller so that no side is longer; as they are where none is."""
    height, width = images.shape[1:3]
    if max(height, width) <= longest:
        return images
    share = longest / max(height, width)
    return all_resized(images, max(1, round(width * share)), max(1, round(height * share)))


def fitted(image: np.ndarray, longest: int) -> np.ndarray:
    """The image made smaller so that no side is longer; as it is where none is."""
    return image if max(image.shape[:2]) <= longest else all_fitted(image[None], longest)[0]


def png(image: np.ndarray) -> bytes | None:
    """An image (one channel, BGR or BGRA) as PNG; None for one without pixels or with another number of channels."""
    height, width, channels = image.shape
    if not image.size or channels not in COLOURS:
        return None
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = image[:, :, order].reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOURS[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def none(data: bytes | None, height: int, width: int, channels: int) -> bool:
    return data is None or not (height > 0 and width > 0 and channels > 0) or len(data) != height * width * channels


@F.pandas_udf(T.BinaryType())
def as_png(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, longest: pd.Series) -> pd.Series:
    """The image as PNG, no side longer than given; null for what is no image."""
    return pd.Series([None if none(*row[:4]) else png(fitted(_pixels(*row[:4]), int(row[4]))) for row in zip(data, height, width, channels, longest)], dtype=object)


def payloads(images: DataFrame, longest: int = MAX_SIDE) -> DataFrame:
    """Images with `png` and `url`, as a model is sent them: no side longer than `longest`, which is kept within limits."""
    most = F.lit(int(clamp(longest, LEAST_SIDE, MOST_SIDE)))
    return images.withColumn("png", as_png("data", "height", "width", "channels", most)).withColumn("url", data_url(F.col("png")))


def _cut(image: np.ndarray, box: dict, pad: int) -> np.ndarray:
    x, y, w, h = (int(box[k]) for k in "xywh")
    return image[max(0, y - pad) : max(0, y + h + pad), max(0, x - pad) : max(0, x + w + pad)]


def field_images(images: DataFrame) -> DataFrame:
    """page_id, field_id, png for each of the boxes (array of field_id, x, y, w, h) of an image, with the small margin.

    png is null where nothing of a box lies in the image. A page without boxes has no row.
    """
    schema = f"page_id {images.schema['page_id'].dataType.simpleString()}, field_id string, png binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                image = None if none(row.data, row.height, row.width, row.channels) else _pixels(row.data, row.height, row.width, row.channels)
                made = [(row.page_id, b["field_id"], None if image is None else png(_cut(image, b, PAD))) for b in (row.boxes if row.boxes is not None else [])]
                yield pd.DataFrame(made, columns=["page_id", "field_id", "png"])

    return images.select("page_id", "height", "width", "channels", "data", "boxes").mapInPandas(run, schema)


def grid(image: np.ndarray, boxes: list[dict]) -> np.ndarray:
    """The boxes of an image in cells of one size, side by side; each as large as it fits above the cell's free strip."""
    down = -(-len(boxes) // ACROSS)
    channels = image.shape[2]
    made = np.full((down * CELL_H, ACROSS * CELL_W, channels), GROUND, np.uint8)
    for k, box in enumerate(boxes):
        cell = made[k // ACROSS * CELL_H :, k % ACROSS * CELL_W :][:CELL_H, :CELL_W]
        cell[:] = 255
        part = _cut(image, box, GRID_PAD)
        if part.size:
            share = min(CELL_W / part.shape[1], (CELL_H - STRIP) / part.shape[0])
            width, height = max(1, int(part.shape[1] * share)), max(1, int(part.shape[0] * share))
            cell[:height, :width] = resized(part, width, height)
    return made


def grids(images: DataFrame) -> DataFrame:
    """page_id, png, cells (field_id, x, y) of each image with boxes: its fields in a grid, in the order of the boxes.

    Names are not drawn, there is no font: `cells` tells whose cell is where. Null png where there is no image or no box.
    """
    schema = f"page_id {images.schema['page_id'].dataType.simpleString()}, png binary, cells array<struct<field_id:string,x:int,y:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                boxes = list(row.boxes) if row.boxes is not None else []
                cells = [{"field_id": b["field_id"], "x": k % ACROSS * CELL_W, "y": k // ACROSS * CELL_H} for k, b in enumerate(boxes)]
                empty = not boxes or none(row.data, row.height, row.width, row.channels)
                made = None if empty else png(grid(_pixels(row.data, row.height, row.width, row.channels), boxes))
                yield pd.DataFrame([(row.page_id, made, cells)], columns=["page_id", "png", "cells"])

    return images.select("page_id", "height", "width", "channels", "data", "boxes").mapInPandas(run, schema)
