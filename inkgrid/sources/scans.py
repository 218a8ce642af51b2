"""Scan clean-up on page images (page_id, height, width, channels, data): warping onto a template, even light, black and white.

Windows are summed by integral images, so that no filter's cost hangs on its size. A page is one image; images are rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkgrid.operators.homography import mapped
from inkgrid.sources.images import all_fitted, none

WHITE = 255.0
#: Output pixels worked out at once.
STRIP = 1 << 18
#: Values of images that are made smaller at once.
STACKED = 1 << 20
#: The side of the window whose mean is the paper's brightness, and of the one that tells ink from paper, with the margin.
LIGHT, INK, MARGIN = 81, 41, 11
# How bright and how colourful a page's pixels are, and what share of an image a page and its quadrilateral cover.
BRIGHT, PALE, PAGE_SHARE, QUAD_SHARE = 70, 125, 0.35, 0.45


def warped(image: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image under a homography, each pixel mixed from the four around where it comes from; beyond the image all is white."""
    back, (rows, columns, channels) = np.linalg.inv(h), image.shape
    framed = np.full((rows + 2, columns + 2, channels), WHITE)
    framed[1:-1, 1:-1] = image
    out = np.empty((height, width, channels), np.uint8)
    step = max(1, STRIP // max(1, width))
    for top in range(0, height, step):
        y, x = np.mgrid[top : min(height, top + step), 0:width]
        p = mapped(back, np.stack([x.ravel(), y.ravel()], 1).astype(float))
        p = np.where(np.isfinite(p), np.clip(p, -1.0, [columns, rows]), -1.0) + 1
        at = np.minimum(p.astype(int), [columns, rows])
        u, v = (p - at).T[..., None]
        c, r = at.T
        mixed = (framed[r, c] * (1 - u) + framed[r, c + 1] * u) * (1 - v) + (framed[r + 1, c] * (1 - u) + framed[r + 1, c + 1] * u) * v
        out[top : top + step] = np.rint(mixed).astype(np.uint8).reshape(-1, width, channels)
    return out


def window_sums(plane: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, count) of the pixels of a square window around each pixel, as far as it lies in the plane."""
    rows, columns = plane.shape
    total = np.zeros((rows + 1, columns + 1), np.int64)
    total[1:, 1:] = plane.cumsum(0, np.int64).cumsum(1)
    r, c, half = np.arange(rows), np.arange(columns), side // 2
    a, b = np.maximum(r - half, 0)[:, None], np.minimum(r + half + 1, rows)[:, None]
    l, e = np.maximum(c - half, 0)[None, :], np.minimum(c + half + 1, columns)[None, :]
    return total[b, e] - total[a, e] - total[b, l] + total[a, l], (b - a) * (e - l)


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness of BGR pixels, or the one channel there is."""
    return np.rint(image[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8) if image.shape[2] >= 3 else image[:, :, 0]


def evened(plane: np.ndarray, side: int = LIGHT) -> np.ndarray:
    """Brightness as a share of the mean around it: shadows go, ink stays."""
    total, count = window_sums(plane, side)
    return np.minimum(255, (plane.astype(np.int64) * 255 * count + total // 2) // np.maximum(total, 1)).astype(np.uint8)


def black_white(plane: np.ndarray, side: int = INK, margin: int = MARGIN) -> np.ndarray:
    """White where a pixel is not darker than the mean around it less a margin, else black."""
    total, count = window_sums(plane, side)
    return np.where((plane.astype(np.int64) + margin) * count > total, 255, 0).astype(np.uint8)


def _grown(mask: np.ndarray, side: int) -> np.ndarray:
    return window_sums(mask, side)[0] > 0


def _shrunk(mask: np.ndarray, side: int) -> np.ndarray:
    total, count = window_sums(mask, side)
    return total == count


def page_quad(image: np.ndarray) -> np.ndarray | None:
    """The corners of the bright page in an image, top left first and clockwise; None where it covers too little.

    Bright, pale pixels, closed and then opened by square windows; the corners are the extremes of x + y and y - x.
    """
    least, most = image[:, :, :3].min(2).astype(int), image[:, :, :3].max(2).astype(int)
    mask = (most >= BRIGHT) & ((most - least) * 255 <= PALE * most)
    short = min(mask.shape)
    close, open_ = max(15, short // 30 | 1), max(7, short // 90 | 1)
    mask = _shrunk(_grown(mask, close), close)
    mask = _grown(_shrunk(mask, open_), open_)
    if mask.mean() < PAGE_SHARE:
        return None
    y, x = np.nonzero(mask)
    corners = np.array([(x[k], y[k]) for k in ((x + y).argmin(), (y - x).argmin(), (x + y).argmax(), (y - x).argmax())], float)
    after = np.roll(corners, -1, 0)
    area = abs((corners[:, 0] * after[:, 1] - after[:, 0] * corners[:, 1]).sum()) / 2
    return corners if area / mask.size >= QUAD_SHARE else None


def onto_rectangle(quad: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """(homography of the quadrilateral onto an upright rectangle, its height) at the quadrilateral's mean aspect."""
    side = [np.hypot(*(quad[k] - quad[(k + 1) % 4])) for k in range(4)]
    height = max(1, round(width * (side[1] + side[3]) / max(1.0, side[0] + side[2])))
    goal = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    left, right = [], []
    for (x, y), (u, v) in zip(quad, goal):
        left += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(left), np.array(right)), 1.0).reshape(3, 3), height


def _each(images: DataFrame, change: Callable[[np.ndarray, pd.Series], np.ndarray | None], needs: list[str]) -> DataFrame:
    """Images changed one by one; one that is none, or that `change` gives nothing for, has null data and -1 sizes."""
    names = ["page_id", "height", "width", "channels", "data"]
    schema = f"page_id {images.schema['page_id'].dataType.simpleString()}, height int, width int, channels int, data binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                fine = row["data"] is not None and row["height"] > 0 and row["width"] > 0
                made = change(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"]), row) if fine else None
                shown = (-1, -1, -1, None) if made is None else (*made.shape, made.tobytes())
                yield pd.DataFrame([(row["page_id"], *shown)], columns=names)

    return images.select(*names, *needs).mapInPandas(run, schema)


def registered_images(images: DataFrame, width: int, height: int) -> DataFrame:
    """Images (with homography and reject_reason, as homography.registered gives them) warped onto the template; rejected ones come without data."""

    def change(image: np.ndarray, row: pd.Series) -> np.ndarray | None:
        if row["homography"] is None or row["reject_reason"]:
            return None
        return warped(image, np.array([list(r) for r in row["homography"]]), width, height)

    return _each(images, change, ["homography", "reject_reason"])


def straightened(images: DataFrame, width: int = 2400) -> DataFrame:
    """Images with their page pulled straight; as they are where no page is found."""

    def change(image: np.ndarray, row: pd.Series) -> np.ndarray:
        quad = page_quad(image) if image.shape[2] >= 3 else None
        if quad is None:
            return image
        h, height = onto_rectangle(quad, width)
        return warped(image, h, width, height)

    return _each(images, change, [])


def cleaned(images: DataFrame, binary: bool = True) -> DataFrame:
    """Images in one channel, evenly lit, and black and white if asked."""
    return _each(images, lambda image, row: (black_white(evened(grey(image))) if binary else evened(grey(image)))[:, :, None], [])


def smaller(images: DataFrame, longest: int) -> DataFrame:
    """Images with no side longer than given; those that fit stay as they are, what is no image has -1 sizes.

    Images of one size are made smaller together, as many as have STACKED values.
    """
    names = ["page_id", "height", "width", "channels", "data"]
    schema = f"page_id {images.schema['page_id'].dataType.simpleString()}, height int, width int, channels int, data binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            page, data, sizes = frame["page_id"], frame["data"].to_numpy(), defaultdict(list)
            for k, row in enumerate(zip(data, frame["height"], frame["width"], frame["channels"])):
                sizes[None if none(*row) else tuple(map(int, row[1:]))].append(k)
            for size, rows in sizes.items():
                if size is None:
                    yield pd.DataFrame({"page_id": page.iloc[rows], **dict.fromkeys(names[1:4], -1), "data": None}, columns=names)
                    continue
                step = max(1, STACKED // math.prod(size))
                for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                    made = all_fitted(np.frombuffer(b"".join(data[some]), np.uint8).reshape(-1, *size), max(1, longest))
                    yield pd.DataFrame({"page_id": page.iloc[some], **dict(zip(names[1:4], made.shape[1:])), "data": [image.tobytes() for image in made]}, columns=names)

    return images.select(*names).mapInPandas(run, schema)
