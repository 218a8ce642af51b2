"""Pixels, homographies and layouts on tiny inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from inkgrid.operators import homography, registration
from inkgrid.sources import images, ocr, scans

IMAGE = "page_id string, height int, width int, channels int, data binary"


def test_checkboxes(spark):
    blank, marked, framed = (np.full((20, 20, 3), 255, np.uint8) for _ in range(3))
    marked[8:12, 8:12] = 0
    framed[:2] = framed[-2:] = 0
    empty = np.zeros((1, 0, 3), np.uint8)
    rows = [(n, *a.shape, a.tobytes()) for n, a in (("blank", blank), ("marked", marked), ("framed", framed), ("empty", empty))]
    got = {r["page_id"]: r for r in images.checkboxes(spark.createDataFrame(rows, IMAGE)).collect()}
    assert {k: r["normalized_value"] for k, r in got.items()} == {"blank": "false", "marked": "checked", "framed": "false", "empty": "false"}
    assert abs(got["marked"]["dark"] - 16 / 144) < 1e-9 and got["empty"]["confidence"] == 0.0


def test_boxes_and_cuts(spark):
    a = (np.arange(300) % 256).astype(np.uint8).reshape(10, 10, 3)
    row = spark.createDataFrame([("p", 10, 10, 3, a.tobytes())], IMAGE)
    cut = row.select(images.cut_out("data", "height", "width", "channels", F.lit(8), F.lit(8), F.lit(5), F.lit(5)).alias("c")).first()["c"]
    assert bytes(cut) == a[2:, 2:].tobytes()
    box = images.widened_pixels(*[F.lit(v) for v in (1, 1, 6, 6, 10, 10)])
    assert tuple(row.select(*[c.alias(k) for k, c in box.items()]).first()) == (0, 0, 9, 9)


def test_homographies(spark):
    eye, flat, stretched, bow = ([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], [[1.0, 0, 0], [1.0, 0, 0], [0, 0, 1.0]], [[1.5, 0, 0], [0, 0.5, 0], [0, 0, 1.0]], [[1.0, 0, 0], [0, 1.0, 0], [-0.03, 0, 1.0]])
    rows = [(n, 101, 101, [[float(x) for x in r] for r in h], 100, 1.0) for n, h in (("eye", eye), ("flat", flat), ("stretched", stretched), ("bow", bow))] + [("few", 101, 101, [[float(x) for x in r] for r in eye], 5, 1.0)]
    made = spark.createDataFrame(rows, "n string, width int, height int, homography array<array<double>>, inliers int, rmse double")
    got = {r["n"]: r["reject_reason"] for r in registration.judged(made, 100, 100).collect()}
    assert got["eye"] == "" and got["flat"] == "area_ratio" and got["stretched"] == "anisotropy" and got["few"] == "inliers" and got["bow"] != ""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9, 9), (0, 1), (1, 8), (8, 0))])
    assert [tuple(q) for q in made.select(registration.ordered_corners(corners).alias("c")).first()["c"]] == [(0, 1), (8, 0), (9, 9), (1, 8)]


def test_layouts(spark):
    result = {"layoutParsingResults": [{"markdown": {"text": "# A"}, "outputImages": {"x": "u"}}, {}]}
    rows = spark.createDataFrame([("p", 1, json.dumps(result))], "page_id string, record_no int, j string").select("page_id", "record_no", F.from_json("j", ocr.LAYOUT).alias("result"))
    assert [(r["page_no"], r["markdown"]) for r in ocr.layout_pages(rows).orderBy("page_no").collect()] == [(0, "# A"), (1, "")]


def planted(rng, n, outliers, noise=0.3):
    """A homography, points under it with some noise, and points that go anywhere."""
    h = np.array([[1.1, 0.05, 30], [-0.04, 0.95, 20], [1e-5, -2e-5, 1]]) + rng.normal(0, [[0.02, 0.02, 5], [0.02, 0.02, 5], [1e-6, 1e-6, 0]])
    src = rng.uniform(0, 2000, (n, 2))
    dst = homography.mapped(h, src) + rng.normal(0, noise, (n, 2))
    lost = rng.random(n) < outliers
    dst[lost] = rng.uniform(0, 2000, (int(lost.sum()), 2))
    return h, src, dst, lost


def test_planted_homographies_are_found():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        h, src, dst, lost = planted(rng, 300, 0.5)
        found, near = homography.estimated(src, dst, seed)
        corners = np.array([[0, 0], [2000, 0], [2000, 2000], [0, 2000.0]])
        assert np.abs(homography.mapped(found, corners) - homography.mapped(h, corners)).max() < 2.0
        assert near[~lost].mean() > 0.99 and near[lost].mean() < 0.05
        assert np.array_equal(near, homography.estimated(src, dst, seed)[1])
    line = np.stack([np.arange(20.0), np.arange(20.0)], 1)
    homography.estimated(line, line[::-1], 1)
    assert homography.estimated(src[:5], dst[:5], 1)[0] is None


def test_registration_from_keypoints(spark):
    """Descriptors of a template seen again with some bits changed, among others: matches equal a plain loop, pages are registered or say why not."""
    rng = np.random.default_rng(3)
    known = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    template = [(float(x), float(y), d.tobytes()) for (x, y), d in zip(rng.uniform(0, 1000, (200, 2)), known)]
    h = np.linalg.inv(np.array([[1.05, 0.02, 12], [-0.03, 0.98, 7], [1e-6, 2e-6, 1]]))
    rows = []
    for k, (x, y, d) in enumerate(template[:150]):
        bits = np.unpackbits(np.frombuffer(d, np.uint8))
        bits[rng.integers(0, 256, 20)] ^= 1
        (px, py), = homography.mapped(h, np.array([[x, y]]))
        rows.append(("good", float(px), float(py), np.packbits(bits).tobytes()))
    rows += [("good", 1.0, 1.0, rng.integers(0, 256, 32, dtype=np.uint8).tobytes()) for _ in range(40)] + [("good", 1.0, 2.0, None), ("good", 1.0, 2.0, b"short")]
    rows += [("few", 1.0, 1.0, template[0][2])] * 3 + [("strange", float(k), 1.0, rng.integers(0, 256, 32, dtype=np.uint8).tobytes()) for k in range(30)]
    points = spark.createDataFrame(rows, "page_id string, x double, y double, descriptor binary")
    frame = spark.createDataFrame(template, "x double, y double, descriptor binary")
    wanted = set()
    for page, x, y, d in rows:
        if d and len(d) == 32:
            apart = sorted((sum((a ^ b).bit_count() for a, b in zip(d, t)), k) for k, (_, _, t) in enumerate(template))
            if apart[0][0] < 0.8 * apart[1][0]:
                wanted.add((page, x, y, template[apart[0][1]][0], apart[0][0]))
    got = homography.matches(points, frame).collect()
    assert {(r["page_id"], r["x"], r["y"], r["tx"], r["distance"]) for r in got} == wanted
    pages = spark.createDataFrame([(p, 1000, 1000) for p in ("good", "few", "strange", "none")], "page_id string, width int, height int")
    out = {r["page_id"]: r for r in homography.registered(pages, points, frame, 1000, 1000).collect()}
    assert {k: r["reject_reason"] for k, r in out.items()} == {"good": "", "few": "features", "strange": "matches", "none": "features"}
    assert out["good"]["inliers"] >= 148 and out["good"]["rmse"] < 0.1
    assert homography.matches(points, frame.limit(1)).count() == 0


def test_matches_of_a_large_template():
    """Points near one descriptor, between two, of twins and near none: as if compared with all, and mostly without doing so."""
    rng = np.random.default_rng(8)
    known = rng.integers(0, 1 << 64, (5000, 4), dtype=np.uint64)
    known[1] = known[0]
    known[3] = known[2] ^ np.uint64(0xFFF)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 4, 12), dtype=np.uint64), 2)
    asked = np.concatenate([known[rng.integers(0, 40, 3000)] ^ (flips(3000) & np.array([0, 0, 0, (1 << 64) - 1], np.uint64)), known[:800] ^ flips(800), rng.integers(0, 1 << 64, (200, 4), dtype=np.uint64), known[:9]])
    for ratio in (0.5, 0.8, 1.0, 1.3):
        at, first, second = homography.nearest_two(asked, known)
        kept = np.flatnonzero(first < ratio * second)
        got = homography.Template(known, ratio).matched(asked)
        assert all(map(np.array_equal, got, (kept, at[kept], first[kept])))
    assert homography.MOST_TEMPLATE >= 360_000


def plain_warp(image, h, width, height):
    back, out = np.linalg.inv(h), np.empty((height, width, image.shape[2]), np.uint8)
    at = lambda r, c: image[r, c].astype(float) if 0 <= r < image.shape[0] and 0 <= c < image.shape[1] else np.full(image.shape[2], 255.0)
    for y in range(height):
        for x in range(width):
            a, b, w = back @ (x, y, 1.0)
            u, v = a / w, b / w
            if not (-1 <= u <= image.shape[1] and -1 <= v <= image.shape[0]):
                out[y, x] = 255
                continue
            c, r = int(np.floor(u)), int(np.floor(v))
            mixed = (at(r, c) * (1 - u + c) + at(r, c + 1) * (u - c)) * (1 - v + r) + (at(r + 1, c) * (1 - u + c) + at(r + 1, c + 1) * (u - c)) * (v - r)
            out[y, x] = np.rint(mixed)
    return out


def test_pixels_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(scans, "STRIP", 64)
    rng = np.random.default_rng(9)
    image = rng.integers(0, 256, (23, 31, 3), dtype=np.uint8)
    h = np.array([[0.8, 0.1, 3.3], [-0.15, 1.1, 2.7], [0.002, -0.001, 1]])
    assert np.abs(scans.warped(image, h, 29, 27).astype(int) - plain_warp(image, h, 29, 27).astype(int)).max() <= 1
    assert np.array_equal(scans.warped(image, np.eye(3), 31, 23), image)
    plane = scans.grey(image)
    for side in (3, 9, 81):
        windows = [[plane[max(0, r - side // 2) : r + side // 2 + 1, max(0, c - side // 2) : c + side // 2 + 1].astype(int) for c in range(31)] for r in range(23)]
        total, count = scans.window_sums(plane, side)
        assert all(total[r, c] == windows[r][c].sum() and count[r, c] == windows[r][c].size for r in range(23) for c in range(31))
        dark = scans.black_white(plane, side, 11)
        assert all((dark[r, c] == 255) == (plane[r, c] > windows[r][c].mean() - 11) for r in range(23) for c in range(31))
        light = scans.evened(plane, side)
        assert all(abs(light[r, c] - min(255, int(plane[r, c]) * 255 / windows[r][c].mean())) <= 1 for r in range(23) for c in range(31))
    rows = [("a", *image.shape, image.tobytes(), h.tolist(), ""), ("b", *image.shape, image.tobytes(), h.tolist(), "rmse"), ("c", -1, -1, -1, None, None, None)]
    made = spark.createDataFrame(rows, f"{IMAGE}, homography array<array<double>>, reject_reason string")
    got = {r["page_id"]: r for r in scans.registered_images(made, 29, 27).collect()}
    assert bytes(got["a"]["data"]) == scans.warped(image, h, 29, 27).tobytes() and got["b"]["data"] is None and got["c"]["height"] == -1
    clean = {r["page_id"]: r for r in scans.cleaned(made).collect()}
    assert (clean["a"]["channels"], set(bytes(clean["a"]["data"])) <= {0, 255}) == (1, True)


def test_pages_are_pulled_straight(spark):
    """A bright quadrilateral on a dark ground comes out as the whole image."""
    image = np.full((300, 400, 3), 20, np.uint8)
    y, x = np.mgrid[0:300, 0:400]
    page = (x > 30 + y * 0.1) & (x < 370 - y * 0.05) & (y > 20) & (y < 280)
    image[page] = 200
    quad = scans.page_quad(image)
    assert np.abs(quad - [[33, 21], [368, 21], [355, 279], [58, 279]]).max() < 8
    assert scans.page_quad(np.full((300, 400, 3), 20, np.uint8)) is None
    small = image.copy()
    small[:, 150:] = 20
    assert scans.page_quad(small) is None
    rows = spark.createDataFrame([("p", *image.shape, image.tobytes()), ("q", *small.shape, small.tobytes())], IMAGE)
    got = {r["page_id"]: r for r in scans.straightened(rows, 200).collect()}
    flat = np.frombuffer(got["p"]["data"], np.uint8).reshape(got["p"]["height"], 200, 3)
    assert (flat > 150).mean() > 0.97 and bytes(got["q"]["data"]) == small.tobytes()
