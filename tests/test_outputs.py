"""Recogniser jobs from files, layout answers, images that go out, and prompts, on tiny inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.operators import asking, layout
from inkgrid.sources import catalog, images, jobs, scans

IMAGE = "page_id string, height int, width int, channels int, data binary"
SETTINGS = Settings()


def record(*texts):
    return json.dumps({"result": {"ocrResults": [{"prunedResult": {"rec_texts": list(texts), "rec_scores": [0.5] * len(texts), "rec_boxes": [[1, 2, 3, 4]] * len(texts)}}]}})


def job(root, page, meta, result):
    folder = root / page
    folder.mkdir(parents=True)
    (folder / "job.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    if result is not None:
        (folder / "result.jsonl").write_text(result)


def test_jobs_are_ingested(spark, tmp_path):
    """Whatever a job folder holds, its page has one row; cached pages are not read again, good ones are saved."""
    root = tmp_path / "jobs"
    fine = {"ok": True, "job_id": "1", "state": "done", "more": {"a": [1]}}
    job(root, "good", fine, record("a", "", "b") + "\n\n" + record("c") + "\n")
    job(root, "empty", fine, "\n")
    job(root, "hollow", fine, "")
    job(root, "half", fine, record("a") + "\n" + record("b")[:-4])
    job(root, "none", fine, None)
    job(root, "why", {"ok": False, "error": "dark", "state": "failed"}, record("a"))
    job(root, "state", {"ok": False, "error": "", "state": "expired"}, None)
    job(root, "mute", {}, None)
    job(root, "torn", '{"ok": tr', record("a"))
    job(root, "void", "", None)
    job(root, "known", '{"ok": tr', None)
    job(root, "nobody", fine, record("a"))
    asked = ["good", "empty", "hollow", "half", "none", "why", "state", "mute", "torn", "void", "known", "stale", "lost", "good"]
    pages = spark.createDataFrame([(p, f"k-{p}") for p in asked], "page_id string, key string")
    entries = [("k-known", '[{"id": "b0000", "text": "z"}]', None), ("k-stale", '[{"id": ', None), ("k-none", "[]", 1.0), ("k-why", "[null]", None), ("k-other", "[]", None)]
    cache = spark.createDataFrame(entries, "key string, answer string, cached_at double")
    rows, saved = jobs.ingested(pages, *jobs.read(spark, str(root)), cache, 1e9, SETTINGS)
    got = rows.collect()
    assert sorted(r["page_id"] for r in got) == sorted(asked)
    errors = {r["page_id"]: r["error"] for r in got}
    assert errors == {
        "good": None, "empty": None, "known": None, "half": "unreadable lines in result.jsonl: 1", "none": "no result.jsonl", "hollow": "no result.jsonl", "why": "dark", "state": "expired", "mute": "ppocr_job_failed",
        "torn": "unreadable job.json", "void": "no job", "stale": "no job", "lost": "no job",
    }
    assert all(r["ok"] == (r["error"] is None) and (r["ok"] or not r["blocks"]) for r in got)
    assert {r["page_id"] for r in got if r["cache_hit"]} == {"known"} and {r["job_id"] for r in got if r["cache_hit"]} == {"cache"}
    found = {(r["page_id"], r["block_id"]): (r["text"], r["cx"]) for r in jobs.blocks(rows).collect()}
    assert found == {("good", "b0000"): ("a", 2.0), ("good", "b0001"): ("b", 2.0), ("good", "b0002"): ("c", 2.0), ("known", "b0000"): ("z", None)}
    kept = {r["key"]: json.loads(r["answer"]) for r in saved.collect()}
    assert {k: len(v) for k, v in kept.items()} == {"k-good": 3, "k-empty": 0}
    again, new = jobs.ingested(pages.filter("page_id = 'good'"), *jobs.read(spark, str(root)), saved, 1e9, SETTINGS)
    assert [(r["cache_hit"], len(r["blocks"])) for r in again.collect()] == [(True, 3)] * 2 and new.count() == 0
    jobs.write(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "errors")).count() == 10 and spark.read.json(str(tmp_path / "out" / "blocks")).count() == 4
    off = jobs.ingested(pages, *jobs.read(spark, str(root)), cache, 1e9, Settings(caches=False))
    assert off[0].filter("cache_hit").count() == 0 and off[1].count() == 0
    assert jobs.ingested(pages.limit(0), *jobs.read(spark, str(root)), cache, 1e9, SETTINGS)[0].count() == 0


def test_layout_answers(spark):
    answers = {
        "fenced": '```json\n{"summary": "ok", "blocks": [1, {"a": 2}], "field_candidates": {"x": {"value": "v"}, "y": 3, "z": {"n": 1}, "n": null, "l": [1]}}\n```',
        "words": 'so {"field_candidates": {}} it is', "text": "no json", "list": '{"field_candidates": [1]}', "open": '{"field_candidates": {', "deep": '{"field_candidates": {"x": {"value": {"a": [1]}}}, "blocks": 3}', "empty": "",
    }
    rows = spark.createDataFrame([(k, v, "raw") for k, v in answers.items()] + [("nothing", None, "r" * 900)], "page_id string, content string, raw string")
    got = {r["page_id"]: r for r in layout.summaries(rows).collect()}
    fenced = got["fenced"]
    assert (fenced["summary"], fenced["block_count"], fenced["raw_preview"]) == ("ok", 2, None)
    assert fenced["field_candidates"] == {"x": "v", "y": "3", "z": None, "n": None, "l": "[1]"}
    assert (got["words"]["field_candidates"], got["words"]["block_count"], got["words"]["summary"]) == ({}, 0, None)
    assert got["deep"]["field_candidates"] == {"x": '{"a":[1]}'} and got["deep"]["block_count"] == 0
    assert {k: got[k]["raw_preview"] for k in ("text", "list", "open", "empty")} == {"text": "no json", "list": answers["list"], "open": answers["open"], "empty": "raw"}
    assert got["nothing"]["raw_preview"] == "r" * 800 and got["text"]["field_candidates"] is None
    assert layout.summaries(rows.limit(0)).count() == 0


def plain_resized(image, width, height):
    """Each pixel by the areas of all pixels it covers."""
    rows, columns = image.shape[:2]
    out = np.zeros((height, width, image.shape[2]))
    for r in range(height):
        for c in range(width):
            t, b, l, e = r * rows / height, (r + 1) * rows / height, c * columns / width, (c + 1) * columns / width
            for y in range(rows):
                for x in range(columns):
                    part = max(0.0, min(b, y + 1) - max(t, y)) * max(0.0, min(e, x + 1) - max(l, x))
                    out[r, c] += part * image[y, x]
            out[r, c] /= (b - t) * (e - l)
    return out


def test_images_out(spark, tmp_path):
    """Sizes equal a plain loop; PNGs are read back by Spark's own reader pixel by pixel."""
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (13, 17, 3), dtype=np.uint8)
    for width, height in ((17, 13), (5, 4), (1, 1), (16, 12), (30, 29)):
        assert np.abs(images.resized(image, width, height) - plain_resized(image, width, height)).max() <= 0.5 + 1e-9
    assert np.array_equal(images.resized(image, 17, 13), image) and images.fitted(image, 17) is image
    assert images.fitted(image, 10).shape == (8, 10, 3) and images.fitted(image[:1], 3).shape == (1, 3, 3)
    kinds = {"grey": image[:, :, :1], "colour": image, "alpha": np.concatenate([image, image[:, :, :1]], 2)}
    for name, made in kinds.items():
        (tmp_path / f"{name}.png").write_bytes(images.png(made))
    back = {r["page_id"].rsplit("/", 1)[1][:-4]: r for r in images.read(spark, str(tmp_path)).collect()}
    for name, made in kinds.items():
        assert (back[name]["height"], back[name]["width"], back[name]["channels"]) == made.shape and bytes(back[name]["data"]) == made.tobytes()
    assert images.png(image[:0]) is None and images.png(image[:, :, :2]) is None
    wide = rng.integers(0, 256, (3, 400, 1), dtype=np.uint8)
    rows = spark.createDataFrame([("a", *wide.shape, wide.tobytes()), ("b", -1, -1, -1, None), ("c", 2, 2, 1, b"123")], IMAGE)
    got = {r["page_id"]: r for r in images.payloads(rows, 1).collect()}
    assert bytes(got["a"]["png"]) == images.png(images.fitted(wide, 320)) and got["a"]["url"].startswith("data:image/png;base64,iVBOR")
    assert got["b"]["png"] is None and got["b"]["url"] is None and got["c"]["png"] is None
    small = {r["page_id"]: r for r in scans.smaller(rows.limit(2), 100).collect()}
    assert (small["a"]["width"], small["a"]["height"]) == (100, 1) and small["b"]["data"] is None


def test_smaller_images_together(spark):
    """Images of one size are made smaller in one piece, with the pixels that each alone would get; other sizes and what is no image go beside them."""
    rng = np.random.default_rng(6)
    sizes = [(4, 8, 1), (7, 5, 3), (3, 2, 1)]
    stacks = [rng.integers(0, 256, (9, *size), dtype=np.uint8) for size in sizes]
    for stack in stacks:
        assert np.array_equal(images.all_fitted(stack, 4), [images.fitted(image, 4) for image in stack])
        plain = [plain_resized(image, 4, 2) for image in stack]
        assert np.abs(images.all_resized(stack, 4, 2) - np.array(plain)).max() <= 0.5 + 1e-9
    rows = [(f"{k}.{n}", *image.shape, image.tobytes()) for n in range(9) for k, image in enumerate(s[n] for s in stacks)] + [("none", -1, -1, -1, None), ("null", None, 1, 1, b"1"), ("short", 2, 2, 1, b"123")]
    got = {r["page_id"]: r for r in scans.smaller(spark.createDataFrame(rows, IMAGE), 4).collect()}
    assert len(got) == len(rows) and all(got[c]["data"] is None and got[c]["width"] == -1 for c in ("none", "null", "short"))
    for n in range(9):
        for k, stack in enumerate(stacks):
            one, row = images.fitted(stack[n], 4), got[f"{k}.{n}"]
            assert (row["height"], row["width"], row["channels"]) == one.shape and bytes(row["data"]) == one.tobytes()


def test_fields_of_an_image(spark):
    image = (np.arange(200 * 400 * 3) % 251).astype(np.uint8).reshape(200, 400, 3)
    boxes = [("big", 0, 0, 400, 200), ("corner", 390, 190, 50, 50), ("outside", 900, 900, 5, 5), ("thin", 50, 50, 2, 1)]
    schema = f"{IMAGE}, boxes array<struct<field_id:string,x:int,y:int,w:int,h:int>>"
    rows = spark.createDataFrame([("p", *image.shape, image.tobytes(), boxes), ("q", *image.shape, image.tobytes(), []), ("r", -1, -1, -1, None, boxes[:1]), ("s", *image.shape, image.tobytes(), None)], schema)
    got = {(r["page_id"], r["field_id"]): r["png"] for r in images.field_images(rows).collect()}
    assert set(got) == {("p", b[0]) for b in boxes} | {("r", "big")}
    assert bytes(got["p", "corner"]) == images.png(image[184:, 384:]) and bytes(got["p", "thin"]) == images.png(image[44:57, 44:58])
    assert got["p", "outside"] is None and got["r", "big"] is None
    made = {r["page_id"]: r for r in images.grids(rows).collect()}
    named = [dict(zip(("field_id", "x", "y", "w", "h"), b)) for b in boxes]
    whole = images.grid(image, named)
    assert whole.shape == (240, 900, 3) and bytes(made["p"]["png"]) == images.png(whole)
    assert [tuple(c) for c in made["p"]["cells"]] == [("big", 0, 0), ("corner", 300, 0), ("outside", 600, 0), ("thin", 0, 120)]
    assert np.array_equal(whole[:92, :184], images.resized(image, 184, 92)) and (whole[92:120, :300] == 255).all() and (whole[:120, 600:] == 255).all() and (whole[120:, 300:] == 245).all()
    assert made["q"]["png"] is None and made["r"]["png"] is None and made["s"]["cells"] == []


CHECK = "page_id string, field_seq int, field_id string, label string, recognizer string, validator string, value string, normalized_value string, confidence double, passed boolean, message string, needs_review boolean, review_reason string"


def test_prompts_and_a_models_choice(spark):
    fields = catalog.from_fields(spark, [
        {"id": n, "label": n.upper(), "section": "s", "bbox": (0, 0, 9, 9), "recognizer": r, "validator": v, "params": p}
        for n, r, v, p in (("a", "numeric_text", "int_range", {"min": 2, "max": 7}), ("b", "keyed_text", "exact_text", {"allow": ["夜班"]}), ("c", "keyed_text", "present", {}))
    ])
    got = {r["field_id"]: r["prompt"] for r in asking.field_prompts(fields).collect()}
    assert "from 2.0 to 7.0" in got["a"] and "digits only" in got["a"] and "夜班" in got["b"] and "present" in got["c"] and all(asking.FIELD_ANSWER in p for p in got.values())
    wanted = spark.createDataFrame([("b",), ("b",), ("z",)], "field_id string")
    assert [r["field_id"] for r in catalog.of_fields(fields, wanted).collect()] == ["b"]
    answers = {
        "p": '```json\n{"problem_items": [{"field_id": " b ", "kind": "failure", "text": "mend b"}, {"field_id": "z", "kind": "failure", "text": "no such"}, null], "reason": "r"}\n```',
        "q": '{"problem_items": []}', "r": "no idea", "s": None,
    }
    rows = spark.createDataFrame([(k, "triage", v, None if v else "late") for k, v in answers.items()], "page_id string, section string, answer string, error string")
    items = [(r["page_id"], r["pos"], r["field_id"], r["kind"], r["text"]) for r in asking.triage_items(rows).collect()]
    assert items == [("p", 0, " b ", "failure", "mend b"), ("p", 1, "z", "failure", "no such")]
