"""From the keypoints of photographed pages to homographies onto a template: nearest descriptors, then a robust estimate.

Keypoints come as rows; what finds them in an image is the caller's. Which estimates make sense is `registration.judged`'s to say.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators import registration

#: A nearest descriptor counts if it is so much nearer than the second; points this near their image are inliers.
RATIO, REACH = 0.8, 4.0
#: Fewest keypoints of a page and fewest matches for an estimate; most keypoints of a template, which is broadcast.
LEAST_POINTS, LEAST_MATCHES, MOST_TEMPLATE = 20, 8, 1 << 20
#: Comparisons at once, draws of four matches at once, and most of such rounds; a round more is not drawn once an all-inlier draw is this likely.
BLOCK, DRAWS, ROUNDS, SURE = 1 << 18, 256, 16, 0.9999
WORDS = 4
#: Descriptors tried of those that have one of the 16-bit pieces; beyond this distance around a descriptor lie too many others to look only there.
TRIED, WIDE = 4, 112
MATCHES = "page_id {0}, x double, y double, tx double, ty double, distance int"
ESTIMATE = "page_id {0}, homography array<array<double>>, matches int, inliers int, rmse double"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words, word by word, so that what is held stays small."""
    apart = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, WORDS):
        apart += np.bitwise_count(a[..., k] ^ b[..., k])
    return apart


def nearest_two(asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, its Hamming distance, the second's) of rows of 64-bit words among others; the first of equals is the nearest.

    Where there is no second, its distance is beyond any.
    """
    at, first, second = (np.zeros(len(asked), np.int64) for _ in range(3))
    step = max(1, BLOCK // len(known))
    for k in range(0, len(asked), step):
        apart = _apart(asked[k : k + step, None, :], known[None, :, :])
        rows = np.arange(len(apart))
        at[k : k + step] = apart.argmin(1)
        first[k : k + step] = apart[rows, at[k : k + step]]
        apart[rows, at[k : k + step]] = np.iinfo(np.int16).max
        second[k : k + step] = apart.min(1)
    return at, first, second


class Template:
    """Descriptors of a template that tell exactly which others match one of them, mostly without comparing with all.

    A descriptor's guess is the nearest of a few that share 16 bits in one place with it. By the triangle inequality, what could
    be nearer, or near enough for a second, lies around the guess: a guess that has no such neighbour is the match, else only
    these neighbours are compared. A bad guess, with much around it, is no guess: then all are compared.
    """

    def __init__(self, known: np.ndarray, ratio: float):
        self.known, self.ratio, self.more = known, ratio, 1 + max(1.0, 1 / ratio)
        pieces = known.view(np.uint16)
        self.order = [np.argsort(p, kind="stable") for p in pieces.T]
        self.start = [np.concatenate([[0], np.bincount(p, minlength=1 << 16).cumsum()]) for p in pieces.T]
        self.alone = np.full(len(known), -1, np.int64)

    def _guessed(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, apart = np.zeros(len(asked), np.int64), np.full(len(asked), 64 * WORDS, np.int64)
        for piece, order, start in zip(asked.view(np.uint16).T, self.order, self.start):
            low, high = start[piece], start[piece.astype(np.int64) + 1]
            for k in range(TRIED):
                rows = np.flatnonzero(low + k < high)
                found = order[low[rows] + k]
                off = _apart(asked[rows], self.known[found])
                nearer = off < apart[rows]
                at[rows[nearer]], apart[rows[nearer]] = found[nearer], off[nearer]
        return at, apart

    def matched(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of those asked that have a match, whom they match, the distance), as nearest_two and the ratio have it."""
        at, first = self._guessed(asked)
        around = first * self.more + 1
        known = np.unique(at[around < WIDE])
        new = known[self.alone[known] < 0]
        self.alone[new] = nearest_two(self.known[new], self.known)[2]
        kept = around < self.alone[at]
        left = np.flatnonzero(~kept)
        left = left[np.argsort(at[left], kind="stable")]
        near, far = left[around[left] < WIDE], left[around[left] >= WIDE]
        groups = np.split(near, np.flatnonzero(np.diff(at[near])) + 1) if len(near) else []
        for rows, others in [(g, np.flatnonzero(_apart(self.known, self.known[at[g[0]]]) <= around[g].max())) for g in groups] + [(far, np.arange(len(self.known)))]:
            which, least, second = nearest_two(asked[rows], self.known[others])
            at[rows], first[rows], kept[rows] = others[which], least, least < self.ratio * second
        rows = np.flatnonzero(kept)
        return rows, at[rows], first[rows]


def matches(points: DataFrame, template: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page_id, x, y, tx, ty, distance of keypoints (page_id, x, y, descriptor of 32 bytes) that have one template keypoint (x, y, descriptor) to themselves.

    The template is one image's keypoints: more than MOST_TEMPLATE are an error. Descriptors that are null or of another size
    match nothing; a template of fewer than two keypoints has no second and matches nothing. See Template for how they are found.
    """
    held = template.filter(F.octet_length("descriptor") == 8 * WORDS).select("x", "y", "descriptor").limit(MOST_TEMPLATE + 1).toArrow()
    if held.num_rows > MOST_TEMPLATE:
        raise ValueError(f"a template has at most {MOST_TEMPLATE} keypoints")
    x, y = (held.column(c).to_numpy().astype(float) for c in ("x", "y"))
    known = np.frombuffer(b"".join(held.column("descriptor").to_pylist()), np.uint64).reshape(-1, WORDS)
    kind = points.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Template(known, ratio) if len(known) > 1 else None
        for batch in batches:
            if batch.num_rows and held:
                asked = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WORDS)
                kept, at, first = held.matched(asked)
                own = [batch.column(k).take(pa.array(kept)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(x[at]), pa.array(y[at]), pa.array(first.astype(np.int32))], [c.split()[0] for c in MATCHES.split(", ")])

    rows = points.filter(F.octet_length("descriptor") == 8 * WORDS)
    return rows.select("page_id", F.col("x").cast("double"), F.col("y").cast("double"), "descriptor").mapInArrow(run, MATCHES.format(kind))


def mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points (n, 2) under homographies (.., 3, 3)."""
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.swapaxes(h, -1, -2)
    with np.errstate(all="ignore"):
        return q[..., :2] / q[..., 2:]


def _scaled(p: np.ndarray) -> np.ndarray:
    """The map that moves points around the origin, at a mean distance of the root of two."""
    mid = p.mean(0)
    size = np.sqrt(2) / max(np.hypot(*(p - mid).T).mean(), 1e-12)
    return np.array([[size, 0, -size * mid[0]], [0, size, -size * mid[1]], [0, 0, 1]])


def _equations(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Two rows of nine for each pair of points (.., n, 2): what a homography's numbers must be orthogonal to."""
    x, y, u, v, one, zero = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1], np.ones(src.shape[:-1]), np.zeros(src.shape[:-1])
    a = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1)
    b = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)
    return np.concatenate([a, b], -2)


def fitted(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homography of least algebraic error, by the direct linear method on scaled points."""
    a, b = _scaled(src), _scaled(dst)
    h = np.linalg.svd(_equations(mapped(a, src), mapped(b, dst)))[2][-1].reshape(3, 3)
    h = np.linalg.inv(b) @ h @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def estimated(src: np.ndarray, dst: np.ndarray, seed: int, reach: float = REACH) -> tuple[np.ndarray | None, np.ndarray]:
    """(homography, which pairs are inliers): the best of random draws of four pairs, fitted again to its inliers.

    Draws hang on the seed alone, so that a retried task repeats them.
    """
    n, rng = len(src), np.random.Generator(np.random.PCG64(seed))
    none = np.zeros(n, bool)
    if n < LEAST_MATCHES:
        return None, none
    a, b = _scaled(src), _scaled(dst)
    from_, to = mapped(a, src), mapped(b, dst)
    best, least = none, np.inf
    for round_ in range(ROUNDS):
        four = rng.random((DRAWS, n)).argpartition(3, axis=1)[:, :4] if n <= 2048 else rng.integers(0, n, (DRAWS, 4))
        rows = _equations(from_[four], to[four])
        left, right = rows[..., :8], -rows[..., 8]
        solid = np.abs(np.linalg.det(left)) > 1e-9
        if solid.any():
            found = np.linalg.solve(left[solid], right[solid][..., None])[..., 0]
            h = np.concatenate([found, np.ones((len(found), 1))], 1).reshape(-1, 3, 3)
            off = np.hypot(*np.moveaxis(mapped(np.linalg.inv(b) @ h @ a, src) - dst, -1, 0))
            off = np.where(np.isfinite(off), off, np.inf)
            near = off <= reach
            cost = np.minimum(off, reach).sum(1)
            k = int(cost.argmin())
            if cost[k] < least:
                best, least = near[k], cost[k]
        share = best.mean()
        if 1 - (1 - share**4) ** (DRAWS * (round_ + 1)) >= SURE:
            break
    if best.sum() < 4:
        return None, none
    for _ in range(4):
        h = fitted(src[best], dst[best])
        off = np.hypot(*(mapped(h, src) - dst).T)
        again = np.isfinite(off) & (off <= reach)
        if again.sum() < 4 or (again == best).all():
            break
        best = again
    return h, best


def homographies(found: DataFrame) -> DataFrame:
    """page_id, homography (null if there is none), matches, inliers, rmse of every page that has matches (page_id, x, y, tx, ty).

    A page's matches, at most one for each of its keypoints, are one group. Their order does not matter.
    """
    kind = found.schema["page_id"].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y", "tx", "ty"], kind="stable")
        src, dst = rows[["x", "y"]].to_numpy(float), rows[["tx", "ty"]].to_numpy(float)
        page = rows["page_id"].iloc[0]
        h, near = estimated(src, dst, zlib.crc32(str(page).encode()))
        rmse = None if h is None else float(np.sqrt(((mapped(h, src[near]) - dst[near]) ** 2).sum(1).mean()))
        return pd.DataFrame([(page, None if h is None else h.tolist(), len(rows), int(near.sum()), rmse)], columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    return found.groupBy("page_id").applyInPandas(one, ESTIMATE.format(kind))


def registered(pages: DataFrame, points: DataFrame, template: DataFrame, template_width: int, template_height: int) -> DataFrame:
    """Pages (page_id, width, height) with homography, inliers, rmse and reject_reason (empty: registered).

    Pages with too few keypoints, too few matches or no estimate say so; the others are judged by registration.judged.
    """
    made = homographies(matches(points, template))
    counts = points.groupBy("page_id").agg(F.count("*").alias("points"))
    rows = pages.join(counts, "page_id", "left").join(made, "page_id", "left")
    rows = rows.withColumns({"points": F.coalesce("points", F.lit(0)), "matches": F.coalesce("matches", F.lit(0)), "inliers": F.coalesce("inliers", F.lit(0))})
    rows = registration.judged(rows, template_width, template_height)
    early = F.when(F.col("points") < LEAST_POINTS, "features").when(F.col("matches") < LEAST_MATCHES, "matches").when(F.col("homography").isNull(), "homography_failed")
    return rows.withColumn("reject_reason", F.coalesce(early, "reject_reason"))
