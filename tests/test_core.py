"""Form inspection on small forms: rules, normalisation, matching, conflicts, cleaning, review, triage, queue, logs."""

from __future__ import annotations

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from inkgrid import config
from inkgrid.config import Settings
from inkgrid.functions import text as t
from inkgrid.operators import asking, caches, clean, logs, match, policies, profile, registration, report, resolve, review, rules, tasks, triage
from inkgrid.plans.inspection import inspect
from inkgrid.sources import bundles, catalog, images, ocr
from inkgrid.streaming import queue
from inkgrid.streaming.leases import task_changes

BLOCKS = "page_id string, block_seq int, block_id string, text string, score double, x1 double, y1 double, x2 double, y2 double"
TODAY = Settings(today="2026-07-02")


def field(id="f", validator="present", recognizer="keyed_text", section="s", bbox=(0, 0, 100, 100), label="L", params=None, **assignment):
    return {"id": id, "label": label, "section": section, "bbox": bbox, "recognizer": recognizer, "validator": validator, "fail_msg": f"{id} fails", "params": params or {}, "assignment": assignment}


def blocks(spark, *found, page="p"):
    return spark.createDataFrame([(page, k, f"b{k:04d}", text, score, *map(float, box)) for k, (text, score, box) in enumerate(found)], BLOCKS)


RULES = [
    ("int_range", {"min": 2, "max": 7}, "f", [("2", 1), ("7 qt", 1), ("8", 0), ("-3", 0), ("none", 0)]),
    ("int_range", {"min": 20, "max": 24}, "oil_eng2_qty", [("73.5", 1), ("79", 0), ("21", 1)]),
    ("int_range", {}, "f", [("3", 0)]),
    ("regex", {"pattern": "^CAACML[0-9]{8}$"}, "f", [("no caacml 00112233", 1), ("CAACML0011223", 0), ("", 0)]),
    ("regex", {"pattern": "^[0-9]{6}$"}, "f", [("no. 445566 of 2025", 1), ("4455667", 0)]),
    ("same_day", {}, "f", [("2026/7/2", 1), ("26.07.02", 1), ("done 2026-7-2 at noon", 1), ("2026-02-07", 0), ("", 0)]),
    ("english_text", {}, "f", [("pump ok", 1), ("pump 正常", 0), ("12", 0)]),
    ("contains_english", {}, "f", [("泵 ok", 1), ("泵", 0)]),
    ("bilingual_text", {"min_letters": 4, "min_cjk": 2}, "f", [("seal 更换", 1), ("sea 更换", 0), ("seal 更", 0)]),
    ("name_not_place", {"not_allow": ["成都"]}, "f", [("欧阳", 1), ("K. Lund", 1), ("成都", 0), ("n / a", 0), ("31", 0), ("release sign", 0), ("?", 0)]),
    ("exact_text", {"allow": ["夜班", "N/A"]}, "f", [("夜 班", 1), ("n-a", 1), ("白班", 0)]),
    ("exact_text", {"allow": ["渝"]}, "f", [("Chung King", 1), ("重庆", 1)]),
    ("prefix_or_exact", {"prefixes": ["wb"], "allow_exact": ["none"]}, "f", [("WB-7", 1), ("NONE", 1), ("XWB", 0)]),
    ("digit_length", {"allow_lengths": [3, 7]}, "f", [("a1b2c3", 1), ("12", 0)]),
    ("number_less_than", {"max": 50}, "f", [("49.9 h", 1), ("50", 0), ("h", 0)]),
    ("optional", {}, "f", [("", 1)]),
    ("present", {}, "f", [("-", 1), ("\u3000", 0)]),
    ("checked", {}, "f", [("YES", 1), ("已勾选", 1), ("", 0)]),
    ("of my own", {}, "f", [("x", 0)]),
]


def test_rules(spark):
    rows = [(k, id_, v, want) for k, (_, _, id_, cases) in enumerate(RULES) for v, want in cases]
    fields = catalog.from_fields(spark, [field(id=f"{k}", validator=name, params=params) for k, (name, params, _, _) in enumerate(RULES)]).withColumn("k", F.col("field_id").cast("int")).drop("field_id")
    made = spark.createDataFrame(rows, "k int, field_id string, value string, want int").withColumn("normalized_value", F.lit(None).cast("string"))
    got = rules.validate(made.join(fields, "k"), TODAY).select("validator", "value", "want", "passed", "message").collect()
    assert not [r for r in got if r["passed"] != bool(r["want"])]
    assert all((r["message"] == "") == r["passed"] for r in got)


def test_own_rule(spark):
    rules.rule("starts_with_x")(lambda value, settings: value.startswith("x"))
    fields = catalog.from_fields(spark, [field(validator="starts_with_x")])
    made = spark.createDataFrame([("f", "xy"), ("f", "y")], "field_id string, value string").withColumn("normalized_value", F.col("value"))
    assert [r["passed"] for r in rules.validate(made.join(fields, "field_id"), TODAY).orderBy("value").collect()] == [True, False]
    del rules.REGISTRY["starts_with_x"]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (t.english_only, {"库信息EW:": "EW:", "FaultmesSge:E/W. COND AFT CRG ISOL VALVE 库信息EW:": "FaultmesSge:E/W. COND AFT CRG ISOL VALVE EW:", "FAULT msg 12 ok": "ok", None: ""}),
        (t.exact_value, {"渝": "重庆", "N-A": "N/A", " chong qing": "重庆", "other ": "other", None: ""}),
        (t.date_text, {"2026-6-9": "2026-06-09", "26.6.9": "2026-06-09", "2026610": "2026-06-10", "2026-13-40": "2026-13-40", "x": "x", "": ""}),
        (t.last_six_digits, {"2026.06.29 017867": "017867", "1234567": "", "a123456b654321": "654321"}),
        (t.digits_or_empty, {" 34 8": "348", "3.5": "", "": ""}),
        (t.without_index, {"08 故障": "故障", "1. - 2、x": "x"}),
        (t.session_id, {None: "default", "  ": "default", " s ": "s"}),
        (t.json_inside, {'```json\n{"a": 1}\n``` bye': '{"a": 1}', "none": None}),
    ],
)
def test_text(spark, make, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", make(F.col("c")).alias("v")).collect()
    assert {r["c"]: r["v"] for r in rows} == cases


def test_words_of_the_form(spark):
    cases = {"SIGN": True, "DESIGN": False, "DATE:": True, "UPDATED": False, "日期": True, "P/N 12": True, "重庆": False, "": False}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", t.is_label(F.col("c")).alias("v")).collect()
    assert {r["c"]: r["v"] for r in rows} == cases


def firsts(spark, fields, found, size=(100, 100), **settings):
    made = match.match(found, catalog.from_fields(spark, fields), Settings(page_width=size[0], page_height=size[1], **settings))
    made = resolve.resolve_conflicts(made)
    out: dict[str, list[str]] = {f["id"]: [] for f in fields}
    for r in made.orderBy("field_seq", "rank").collect():
        out[r["field_id"]].append(r["text"])
    return out


def test_matching(spark):
    got = firsts(spark, [field("n", "digit_length", bbox=(500, 1600, 100, 100), params={"allow_lengths": [4]})], blocks(spark, ("2238", 0.99, (520, 1610, 600, 1680)), ("x", 0.1, (950, 1950, 990, 1990))), (1000, 2000))
    assert got["n"] == ["2238"]
    got = firsts(spark, [field("n", "int_range", params={"min": 0, "max": 4}, value_type="numeric", row="last")], blocks(spark, ("4", 0.99, (10, 20, 30, 40)), ("0", 0.99, (20, 72, 42, 92))))
    assert got["n"][0] == "0"
    got = firsts(spark, [field("n", "name_not_place", bbox=(0, 0, 240, 100), value_type="signature")], blocks(spark, ("重庆", 0.9, (10, 10, 60, 40)), ("CONSIDERED FIT FOR RELEASE", 0.9, (60, 10, 160, 40)), ("李冬", 0.9, (170, 10, 230, 40))), (240, 100))
    assert got["n"] == ["李冬"]
    got = firsts(spark, [field("n", "regex", bbox=(0, 0, 260, 100), params={"pattern": "^[0-9]{6}$"}, value_type="authorization")], blocks(spark, ("2026.06.29", 0.99, (10, 10, 120, 60)), ("017867", 0.9, (130, 10, 240, 60))), (260, 100))
    assert got["n"] == ["017867"]
    got = firsts(spark, [field("n", "optional", value_type="text")], blocks(spark, ("重庆", 0.9, (10, 10, 60, 40))))
    assert got["n"] == []


def test_a_block_is_first_evidence_once(spark):
    two = [field("place", "exact_text", params={"allow": ["重庆"]}, value_type="closed"), field("ref", "present")]
    got = firsts(spark, two, blocks(spark, ("重庆", 0.9, (10, 10, 90, 90))))
    assert got == {"place": ["重庆"], "ref": []}


def test_candidates_are_cut_and_ties_keep_order(spark):
    found = blocks(spark, *[("7", 0.5, (10, 10, 30, 30)) for _ in range(12)])
    made = match.match(found, catalog.from_fields(spark, [field("n", "int_range", params={"min": 0, "max": 9})]), Settings(page_width=100, page_height=100))
    assert [r["block_seq"] for r in made.orderBy("rank").collect()] == list(range(8))


def test_oil_row(spark):
    boxes = {"oil_eng1_added": 170, "oil_eng1_qty": 310, "oil_eng2_added": 470, "oil_eng2_qty": 580, "oil_apu_added": 700}
    fields = [field(k, "int_range", section="oil", bbox=(x, 635, 140, 58), params={"min": 0, "max": 25}, value_type="numeric") for k, x in boxes.items()]
    values = ["0", "20.5", "0", "20.5", "0"]
    row = [(v, 0.9, (200 + 130 * k, 640 + k % 3, 240 + 130 * k, 680 + k % 3)) for k, v in enumerate(values)]
    above = [("9", 0.9, (300, 570, 330, 600))]
    found = blocks(spark, *reversed(row), *above, ("边界", 0.9, (2300, 1650, 2307, 1715)))
    settings = Settings()
    made = resolve.oil_row(found, catalog.from_fields(spark, fields), settings)
    got = {r["field_id"]: r["text"] for r in made.collect()}
    assert got == dict(zip(boxes, values))
    shown = inspect(found, catalog.from_fields(spark, fields), settings).candidates.filter("rank = 1")
    assert {r["reason"] for r in shown.collect()} == {"oil_pf_row_sequence"}
    assert resolve.oil_row(found, catalog.from_fields(spark, fields[:4]), settings).count() == 0


CANDS = "array<struct<rank:int,text:string,cand_score:double,x1:double,y1:double,x2:double,y2:double,cy:double,reason:string>>"


def cands(*found):
    return [(k + 1, text, score, *map(float, box), (box[1] + box[3]) / 2, "") for k, (text, score, box) in enumerate(found)]


@pytest.mark.parametrize(
    ("found", "want"),
    [
        ([("348", 2.4, (20, 20, 92, 64)), ("1", 0.9, (98, 21, 118, 63))], "3481"),
        ([("3481", 2.4, (130, 20, 220, 64)), ("2238", 1.3, (20, 20, 105, 64))], "3481"),
        ([("2238", 2.4, (20, 20, 104, 64)), ("1", 0.9, (110, 21, 130, 63))], "2238"),
        ([("x", 2.4, (20, 20, 104, 64))], "x"),
        ([], ""),
    ],
)
def test_digits_are_joined(spark, found, want):
    f = catalog.from_fields(spark, [field("n", "number_less_than", params={"max": 99999})])
    row = spark.createDataFrame([("n", cands(*found))], f"field_id string, cands {CANDS}").join(f, "field_id")
    assert row.select(clean.best_text(F.col("cands")).alias("v")).first()["v"] == want


def test_ambiguity(spark):
    f = catalog.from_fields(spark, [field("n", "number_less_than", section="apu", params={"max": 999999})])
    for (a, b), want in {(2.6, 2.1): True, (2.6, 1.2): False}.items():
        row = spark.createDataFrame([("n", cands(("5789", a, (0, 0, 9, 9)), ("114121", b, (0, 0, 9, 9))))], f"field_id string, cands {CANDS}").join(f, "field_id")
        assert (row.select(review.ambiguity(F.col("cands")).alias("v")).first()["v"] != "") == want


def checks(spark, *rows):
    """(field, value, passed, needs_review, confidence) of one page."""
    fields = catalog.from_fields(spark, [r[0] for r in rows])
    made = spark.createDataFrame([("p", r[0]["id"], r[1], r[1], r[4], "local:fallback_cleaner", "m", r[3], "", r[2], "" if r[2] else f"{r[0]['id']} fails") for r in rows],
        "page_id string, field_id string, value string, normalized_value string, confidence double, provider string, model string, needs_review boolean, review_reason string, passed boolean, message string")
    return made.join(fields, "field_id")


READING = "page_id string, field_id string, value string, normalized_value string, confidence double, provider string, model string, error string"


def test_review_budget_and_merge(spark):
    made = checks(
        spark,
        (field("lic", "regex", label="29 执照号", params={"pattern": "^CAACML[0-9]{8}$"}), "x", False, False, 0.9),
        (field("day", "same_day", label="16 日期"), "", False, False, 0.0),
        (field("apu", "number_less_than", label="23 APU", params={"max": 99999}, roi_review_always=True), "348", True, True, 0.9),
        (field("at", "exact_text", label="15 地点", params={"allow": ["重庆"]}), "", False, False, 0.0),
    )
    settings = Settings(review_limit=2)
    planned = review.budgeted(made, settings)
    got = {r["field_id"]: r["selected"] for r in planned.filter("eligible").collect()}
    assert got == {"lic": True, "apu": True, "day": False, "at": False}
    plan = review.plan(planned, settings).first()
    assert (plan["eligible_count"], plan["selected_count"], plan["skipped_count"]) == (4, 2, 2) and [i["field_id"] for i in plan["selected_items"]] == ["lic", "apu"]
    for confidence, value, taken in ((0.91, "3481", True), (0.42, "3481", False), (0.9, "none", False)):
        readings = spark.createDataFrame([("p", "apu", value, None, confidence, "v", "m", None)], READING)
        out = {r["field_id"]: r for r in review.merge(planned, readings, settings).collect()}
        apu, lic = out["apu"], out["lic"]
        assert (apu["value"], apu["accepted"], apu["needs_review"]) == (("3481", True, False) if taken else ("348", False, True))
        assert apu["changed"] and lic["review_reason"] == "缺少ROI复核图" and out["day"]["review_skipped"]


def test_triage(spark):
    made = checks(
        spark,
        (field("at", "exact_text", label="09 地点"), "", False, False, 0.5),
        (field("lic", "regex", label="29 执照号"), "", False, True, 0.5),
        (field("day", "same_day", label="16 日期"), "", False, False, 0.5),
        (field("apu", "number_less_than", label="23 APU累计使用循环"), "1", True, True, 0.5),
    ).withColumns({"reviewed": F.lit(False), "changed": F.lit(False), "review_skipped": F.lit(False)})
    shown = lambda n: [r["text"] for r in triage.top_issues(made, Settings(issue_limit=n)).orderBy("slot").collect()]
    assert shown(1) == ["lic fails"] and shown(2) == ["lic fails", "day fails"]
    assert shown(4) == ["lic fails", "day fails", "at fails", "23 APU累计使用循环需复核"]
    assert {r["field_id"] for r in triage.suppressed(made, Settings(issue_limit=2)).collect()} == {"at", "apu"}
    said = spark.createDataFrame([("p", 0, "APU累计使用循环需要人工确认"), ("p", 1, "LIC FAILS"), ("p", 2, "?")], "page_id string, pos int, text string")
    got = {r["pos"]: (r["field_id"], r["kind"]) for r in triage.attributed(said, made).collect()}
    assert got == {0: ("apu", "review"), 1: ("lic", "failure"), 2: ("", "summary")}
    items = spark.createDataFrame([("p", 0, "nope", "failure", "x"), ("p", 1, "apu", "failure", "x"), ("p", 2, "lic", "", ""), ("p", 3, "lic", "", "again")], "page_id string, pos int, field_id string, kind string, text string")
    assert [(r["field_id"], r["text"]) for r in triage.accepted_items(items, made, Settings()).collect()] == [("lic", "lic fails")]
    for answer, want in (
        ('{"problem_items": [{"field_id": "apu", "kind": "review", "text": "see apu"}, {"field_id": "at"}, {"field_id": "zz", "kind": "failure", "text": "x"}]}', [(1, "apu", "see apu", "review"), (2, "at", "at fails", "failure")]),
        ('{"problem_items": [{"field_id": "zz", "kind": "failure", "text": "x"}]}', [(1, "lic", "lic fails", "failure"), (2, "day", "day fails", "failure")]),
        ("no", [(1, "lic", "lic fails", "failure"), (2, "day", "day fails", "failure")]),
    ):
        got = asking.triaged(made, lambda prompt, answer=answer: answer, Settings(issue_limit=2)).orderBy("slot").collect()
        assert [(r["slot"], r["field_id"], r["text"], r["kind"]) for r in got] == want
    shown = asking.triage_prompts(made, Settings(issue_limit=3)).first()["prompt"]
    assert "at most 3" in shown.split("\n")[0] and [i["id"] for i in json.loads(shown.split("\n", 1)[1])] == ["at", "lic", "day", "apu"]


@pytest.mark.parametrize(("bbox", "image", "page", "x", "y", "w", "h"), [((690, 1678, 230, 100), (1200, 892), (2400.0, 1784.0), (338, 346), (820, 836), (140, 155), (55, 70))])
def test_evidence_box(spark, bbox, image, page, x, y, w, h):
    f = catalog.from_fields(spark, [field("n", "number_less_than", bbox=bbox, params={"max": 9999}, value_type="numeric", roi_review=True)])
    row = spark.createDataFrame([("p", "n", [], *image, *page)], f"page_id string, field_id string, cands {CANDS}, image_w int, image_h int, page_w double, page_h double").join(f, "field_id")
    got = review.evidence_boxes(row, Settings()).first()
    assert all(lo <= got[k] <= hi for k, (lo, hi) in zip("xywh", (x, y, w, h)))


def test_whole_plan(spark):
    fields = catalog.from_fields(spark, catalog.SAMPLE)
    at = {f["id"]: f["bbox"] for f in catalog.SAMPLE}
    inside = lambda id: (at[id][0] + 20, at[id][1] + 20, at[id][0] + 200, at[id][1] + 90)
    found = blocks(spark, ("22380", 0.9, inside("asset_tag")), ("渝", 0.9, inside("site")), ("边", 0.9, (2300, 1700, 2308, 1715)))
    made = inspect(found, fields, TODAY)
    row = made.reports.first()
    assert row["summary"]["field_count"] == len(catalog.SAMPLE) and not row["ok"]
    assert row["problems"] == [r["text"] for r in made.shown.orderBy("slot").collect()] and len(row["problems"]) == 4
    assert made.summary.first().asDict() == {"page_id": "p", "ok": row["ok"], **row["summary"].asDict()}
    values = {f["id"]: (f["normalized_value"], f["passed"]) for f in row["fields"]}
    assert values["asset_tag"] == ("22380", True) and values["site"] == ("重庆", True)
    held = json.loads(report.candidates_json(made.candidates).first()["candidates"])
    assert held["asset_tag"][0]["text"] == "22380" and "rank" not in held["asset_tag"][0]


def test_catalogue_from_yaml(spark):
    document = "canonical: {width: 100, height: 50}\nfields:\n  - {id: a, label: A, section: s, bbox: [1, 2, 3, 4], recognizer: r, validator: number_less_than, params: {max: 9999}}\n"
    df, size = catalog.from_yaml(spark, document)
    row = df.first()
    assert size == (100, 50) and row["fail_msg"] == "A不符合要求" and row["max_digits"] == 4 and row["target"]["w"] == 3


def test_recogniser_output(spark, tmp_path):
    line = {"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["TSM21", "", "2238"], "rec_scores": [0.87, 0.5, 0.99], "rec_boxes": [[10, 20, 110, 40], [0, 0, 1, 1], [50, 80, 90, 120]]}, "ocrImage": "http://i/1"}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line) + "\n\n")
    results = ocr.read_results(spark, str(tmp_path))
    got = ocr.blocks(results).orderBy("block_seq").collect()
    assert [(r["block_id"], r["text"], r["cx"], r["cy"]) for r in got] == [("b0000", "TSM21", 60.0, 30.0), ("b0001", "2238", 70.0, 100.0)]
    assert ocr.text_rows(results).count() == 3 and ocr.image_urls(results).first()["url"] == "http://i/1"


def state(spark, rows):
    """Tasks after events (task, kind, at)."""
    made = spark.createDataFrame([(*r[:1], "s", *r[1:], None, None, "e" if r[1] == "failed" else None, None, r[0], "/up/a.png", None) for r in rows], tasks.EVENTS)
    return tasks.current(made, Settings())


def test_queue(spark):
    rows = [("a", "created", 10.0), ("b", "created", 20.0), ("b", "claimed", 30.0), ("c", "created", 5.0), ("c", "claimed", 6.0), ("c", "done", 9.0)]
    now = state(spark, rows)
    assert {r["task_id"]: r["status"] for r in now.collect()} == {"a": "pending", "b": "running", "c": "done"}
    assert [r["task_id"] for r in tasks.claim(now, 99.0, Settings(), 5).collect()] == ["a"]
    back = {r["task_id"]: (r["status"], r["recovered"]) for r in tasks.recover_stale(now, 30.0 + 1801).collect()}
    assert back == {"a": ("pending", False), "b": ("pending", True), "c": ("done", False)}
    assert {r["task_id"] for r in tasks.of_session(now, " s ").collect()} == {"a", "b", "c"} and tasks.of_session(now, None).count() == 0
    links = {r["task_id"]: (r["upload_url"], r["report_url"]) for r in tasks.with_links(now).collect()}
    assert links == {k: (f"/runs/{k}/a.png", None) for k in "abc"}
    assert tasks.one(now, "b")["status"] == "running"
    with pytest.raises(KeyError):
        tasks.one(now, "z")
    reports = spark.createDataFrame([("/r", "{}")], "report_path string, report string")
    assert tasks.with_reports(now, reports).filter("report is null").count() == 3


@pytest.mark.parametrize("turn", [1, -1])
def test_events_of_one_moment_have_one_order(spark, turn):
    """created < recovered < claimed < progress < failed < done, whichever comes first in the table."""
    rows = [("a", "created", 1.0), ("a", "claimed", 1.0), ("b", "recovered", 1.0), ("b", "claimed", 1.0), ("c", "failed", 1.0), ("c", "done", 1.0), ("d", "claimed", 1.0), ("d", "failed", 1.0)]
    got = {r["task_id"]: (r["status"], json.loads(r["progress"]).get("stage"), r["error"]) for r in state(spark, rows[::turn]).collect()}
    assert got == {"a": ("running", "started", None), "b": ("running", "started", None), "c": ("done", "final", None), "d": ("failed", "error", "e")}


def test_transitions_are_events(spark):
    """A task's life written through the functions: each state has the transition's own progress document."""
    asked = spark.createDataFrame([("t", "  ", None, "/up/x.png", "q")], "task_id string, session_id string, filename string, upload_path string, request_id string")
    events, settings, seen = tasks.created(asked, 1.0), Settings(), []

    def now():
        row = tasks.current(events, settings).first()
        seen.append((row["status"], json.loads(row["progress"]), row["lease_expires_at"], row["error"], row["attempt_count"]))
        return tasks.current(events, settings)

    first = now().first()
    assert (first["session_id"], first["filename"], first["run_id"], first["request_id"]) == ("default", "x.png", "t", "q")
    events = events.unionByName(tasks.claimed(tasks.claim(now(), 2.0, settings), 2.0))
    events = events.unionByName(tasks.progressed(now().withColumn("progress", F.lit('{"stage": "half"}')), 3.0))
    events = events.unionByName(tasks.recovered(tasks.recover_stale(now(), 9999.0), 9999.0))
    events = events.unionByName(tasks.claimed(tasks.claim(now(), 10000.0, settings), 10000.0))
    events = events.unionByName(tasks.failed(now().withColumn("error", F.lit('a "b"')), 10001.0))
    now()
    assert [(s, p["stage"], lease, e, n) for s, p, lease, e, n in seen[1:]] == [
        ("pending", "pending", None, None, 0), ("running", "started", 1802.0, None, 1), ("running", "half", 1803.0, None, 1), ("pending", "pending", None, None, 1), ("running", "started", 11800.0, None, 2), ("failed", "error", None, 'a "b"', 2),
    ]
    assert seen[4][1]["reason"] == "recovered_stale_running_task" and seen[-1][1]["error"] == 'a "b"'
    done = tasks.current(events.unionByName(tasks.finished(asked.withColumn("report_path", F.lit("/r.json")), 10002.0)), settings)
    row = tasks.with_links(done).first()
    assert (row["status"], row["error"], row["report_url"], json.loads(row["progress"])) == ("done", None, "/runs/t/report.json", {"stage": "final", "status": "done"})


def test_caches(spark):
    cache = spark.createDataFrame([("k1", None), ("k2", 50.0), ("k3", 5000.0)], "key string, cached_at double").withColumn("answer", F.col("key"))
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "key string")
    live = caches.live(cache, 6000.0, Settings())
    assert {r["key"] for r in caches.hits(asked, live).collect()} == {"k1", "k3"} and {r["key"] for r in caches.misses(asked, live).collect()} == {"k2", "k4"}
    assert {r["key"] for r in caches.live(cache, 6000.0, Settings(cache_ttl_s=0)).collect()} == {"k1"}
    assert caches.answered(asked, live).filter("cache_hit").count() == 2


def test_cache_entries(spark):
    """Good readings are saved, timeouts with their time, errors and empty readings never; nothing when caches are off."""
    rows = [("k1", "a", "v", None, False), ("k2", "b", "", None, False), ("k3", "c", "v", "bad", False), ("k4", "d", "", "late", True), ("k5", "z", "v", None, False), ("k5", "y", "v", None, None), ("k5", "a", "", "late", True)]
    results = spark.createDataFrame([(*r[:3], None, *r[3:]) for r in rows], "key string, answer string, value string, normalized_value string, error string, timed_out boolean")
    got = {tuple(r) for r in caches.entries(results, 9.0, Settings()).collect()}
    assert got == {("k1", "a", None), ("k4", "d", 9.0), ("k5", "y", None)}
    assert {r["key"] for r in caches.entries(results, 9.0, Settings(cache_ttl_s=0)).collect()} == {"k1", "k5"}
    off = Settings(caches=False)
    assert caches.entries(results, 9.0, off).count() == 0 and caches.live(caches.entries(results, 9.0, Settings()), 9.0, off).count() == 0


def test_reading_keys_tell_models_apart(spark):
    rows = catalog.from_fields(spark, [field()]).withColumns({"m": F.lit("m1"), "image": F.lit(b"x")})
    made = lambda m: rows.select(caches.reading_key(F.lit("p"), F.lit(m).cast("string"), F.col("image"), "v1")).first()[0]
    assert len({made("m1"), made("m2"), made(None)}) == 3 and made("m1") == made("m1")


def test_saved_caches_are_read_again(spark, tmp_path):
    for k, at in (("k1", 1.0), ("k2", 2.0)):
        results = spark.createDataFrame([(k, k.upper(), "v", None, None, False)], "key string, answer string, value string, normalized_value string, error string, timed_out boolean")
        caches.save(results, at, Settings(), str(tmp_path / "c"))
    asked = spark.createDataFrame([("k2",), ("k3",)], "key string")
    got = {r["key"]: (r["answer"], r["cache_hit"]) for r in caches.answered(asked, spark.read.parquet(str(tmp_path / "c"))).collect()}
    assert got == {"k2": ("K2", True), "k3": (None, False)}


def test_logs(spark, tmp_path):
    """Real lines: no numbers, keys of their own, rotated files; what is written is read again without secrets."""
    old = ['{"event": "a", "task_id": "t", "size": 3, "deep": {"x": [1]}}', "no json", "[1]", '{"event": "b", "task_id": "t"}']
    (tmp_path / "in").mkdir()
    for name, rows, when in (("app.log.1", old, 1000), ("app.log", ['{"event": "c", "task_id": "u", "token": "s", "message": ""}', '{"event": "d", "task_id": "t"}'], 2000)):
        (tmp_path / "in" / name).write_text("\n".join(rows))
        os.utime(tmp_path / "in" / name, (when, when))
    found = logs.read(spark, str(tmp_path / "in"))
    assert [r["event"] for r in logs.tail(found, 9).collect()] == ["a", "b", "c", "d"]
    assert [r["event"] for r in logs.tail(found, 2, task_id="t").collect()] == ["b", "d"] and logs.tail(found, 0).count() == 1
    first = found.filter("event = 'a'").first()
    assert first["payload"]["size"] == "3" and json.loads(first["payload"]["deep"]) == {"x": [1]}
    logs.write(found.withColumn("ts", F.lit("2024-05-06T00:00:00")), str(tmp_path / "out"))
    again = {r["event"]: r for r in logs.read(spark, str(tmp_path / "out")).collect()}
    assert set(again) == set("abcd") and again["c"]["payload"] == {"token": "[redacted]"} and again["c"]["message"] is None
    assert (tmp_path / "out/day=2024-05-06").is_dir()
    made = spark.createDataFrame([('{"a": [{"Api_Key": "x", "k": 1}], "usage_tokens": 3}',), ("no json",), (None,)], "j string")
    got = [r[0] for r in made.select(logs.redacted_json("j")).collect()]
    assert json.loads(got[0]) == {"a": [{"Api_Key": "[redacted]", "k": 1}], "usage_tokens": "[redacted]"} and got[1:] == ["no json", None]
    events = spark.createDataFrame([("s", k, p) for k, p in enumerate(["a", "a", None, None, "a"])], "s string, n int, p string")
    assert [r["n"] for r in logs.without_repeats(events, "s", "n", "p").orderBy("n").collect()] == [0, 2, 4]


def test_profile(spark):
    found = blocks(
        spark, ("日 2024.01.02", 0.9, (0, 900, 10, 910)), ("amm12-3", 0.91239, (20, 0, 30, 10)), ("123", 0.9, (340, 900, 350, 910)), ("4567", 0.9, (430, 900, 440, 910)), ("12", 0.9, (340, 900, 350, 910)),
        ("the pump leaks badly", 0.9, (0, 400, 10, 410)), ("2024-01-02", 0.9, (0, 0, 10, 10)),
    )
    got = {(r["text"], r["family"]) for r in profile.families(found).collect()}
    assert got == {("日 2024.01.02", "dates"), ("2024-01-02", "dates"), ("amm12-3", "refs"), ("123", "digit_3_5"), ("4567", "digit_3_5"), ("the pump leaks badly", "english_fault")}
    guessed = {(r["text"], r["guess"]) for r in profile.guessed(found).collect()}
    assert guessed == {("日 2024.01.02", "awr_date"), ("amm12-3", "fault_ref"), ("123", "apu_cum_hours"), ("4567", "apu_cum_cycles"), ("the pump leaks badly", "fault_report_en")}
    row = profile.comparison(found).first()
    held = json.loads(row["json"])
    assert held["counts"]["dates"] == 2 and held["field_guesses"]["fault_ref"] == [{"text": "amm12-3", "score": 0.9124, "box": [20.0, 0.0, 30.0, 10.0], "center": [25.0, 5.0]}]
    assert "- dates: 2" in row["markdown"] and "- fault_ref: `amm12-3`" in row["markdown"]


def test_policies(spark):
    made = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    text = lambda v: F.lit(v).cast("string")
    sure = lambda stated, model, value: made(policies.confidence(text(stated), text(model), text(value), text("")))
    assert [sure("0", "Fast-OCR", "x"), sure(None, "fast-ocr", ""), sure("-2", "vl", "x"), sure("0.3", "ocr", "x"), sure("high", "ocr", "x")] == [0.72, 0.0, -2.0, 0.3, 0.72]
    asking = Settings(fallback_model="spare")
    again = lambda provider, model, value, error: made(policies.asks_again(text(provider), text(model), text(value), text(""), text(error), asking))
    assert [again("aliyun", "m", "", "late"), again("aliyun", "m", "x", "late"), again("aliyun", "m", "", None), again("aliyun", "spare", "", "late"), again("own", "m", "", "late"), again("aliyun", None, None, "late")] == [True, False, False, False, False, True]
    assert not made(policies.asks_again(text("aliyun"), text("m"), text(""), text(""), text("late"), Settings()))
    skips = lambda error, sections, on=True: made(policies.skips_triage(text(error), F.array(*map(F.lit, sections)).cast("array<string>"), Settings(skip_triage_on_error=on)))
    assert [skips("late", []), skips("", ["oil"]), skips(None, []), skips("late", [], False)] == [True, True, False, False]
    answers = spark.createDataFrame([('```json\n{"value": "7", "confidence": 0.9}\n```',), ("plain",), ("{bad}",), (None,)], "answer string").withColumn("model", F.lit("m"))
    got = [(r["value"], r["normalized_value"], r["confidence"], r["error"]) for r in policies.readings(answers).collect()]
    assert got[:3] == [("7", "7", 0.9, None), ("plain", "plain", 0.5, None), ("", "", 0.0, "unreadable answer")]
    rows = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "page_id string, field_id string")
    one, two = (spark.createDataFrame(r, "page_id string, field_id string, path string") for r in ([("p", "a", "1a")], [("p", "a", "2a"), ("p", "b", "2b")]))
    assert {r["field_id"]: r["evidence_path"] for r in policies.evidence_of(rows, one, two).collect()} == {"a": "1a", "b": "2b", "c": None}
    assert config.switched_on(" Yes ") and not config.switched_on("OFF")


def test_finished_results(spark, tmp_path):
    assert bundles.optional_json(spark, str(tmp_path / "none"), "a int").count() == 0 and bundles.optional_text(spark, str(tmp_path / "none")) == ""
    row = bundles.run_summary(spark, str(tmp_path)).first()
    assert not row["exists"] and row["model"] is None
    (tmp_path / "summary.json").write_text('{"model": "m", "records": 2}')
    row = bundles.run_summary(spark, str(tmp_path)).first()
    assert row["exists"] and row["records"] == 2 and row["markdown_files"] == []
    report_ = {"ok": True, "fields": [{"id": "a", "value": "", "provider": "mock"}, {"id": "b", "value": "x", "needs_review": False, "review_reason": "r", "source_label": "S"}, {"id": "c", "value": "x"}]}
    (tmp_path / "report.json").write_text(json.dumps(report_))
    reports = bundles.optional_json(spark, str(tmp_path / "report.json"), bundles.REPORT)
    got = [(f["id"], f["source_label"], f["needs_review"], f["review_reason"]) for f in bundles.with_defaults(reports, report.source_label(F.col("provider"), F.lit(False)), ("c",)).first()["fields"]]
    assert got == [("a", "Unresolved", True, bundles.REVIEW_REASON), ("b", "S", False, "r"), ("c", "ROI-VLM", True, bundles.REVIEW_REASON)]


def test_registration_record(spark):
    rows = [("a", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 90, 1.0, ""), ("b", None, None, None, None), ("c", [[1.0, 0.0, 0.0]] * 3, 5, 1.0, "inliers")]
    made = spark.createDataFrame(rows, "page_id string, homography array<array<double>>, inliers int, rmse double, reject_reason string")
    got = {r["page_id"]: json.loads(r["registration"]) for r in registration.record(made, "sift").collect()}
    assert got["a"]["ok"] and got["a"]["reject_reason"] is None and got["c"] == {**got["c"], "ok": False, "reject_reason": "inliers"}
    assert {k: got["b"][k] for k in ("enabled", "ok", "inliers", "reproj_rmse", "reject_reason")} == {"enabled": False, "ok": False, "inliers": 0, "reproj_rmse": None, "reject_reason": "REGISTRATION_MODE=off"}
    assert spark.range(1).select(images.data_url(F.lit(b"abc"))).first()[0] == "data:image/png;base64,YWJj"


def test_a_models_values_come_in_by_a_hook(spark):
    """The hook's values stand over the local ones and are checked."""
    fields = catalog.from_fields(spark, [field("n", "digit_length", params={"allow_lengths": [4]})])
    found = blocks(spark, ("12", 0.9, (10, 10, 60, 60)))
    say = lambda rows: rows.select("page_id", "field_id", F.lit("1234").alias("value"), F.lit("1234").alias("normalized_value"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"))
    settings = Settings(page_width=100, page_height=100)
    assert [inspect(found, fields, settings, cleaner=c).checks.first()["passed"] for c in (None, say)] == [False, True]


def test_derived_forms_reach_both_outcomes(spark):
    """Every rule but `optional` passes some text of the derived forms and fails another; bodies are joined; reviews have all endings."""
    from inkgrid import registry

    sf = "/root/testdata/sf0.001"
    for name in registry.QUERIES:
        if name.startswith("rule_") and name != "rule_optional":
            assert {r[0] for r in registry.QUERIES[name](spark, sf).select("passed").distinct().collect()} == {True, False}, name
    cleaned = registry.QUERIES["local_clean"](spark, sf).filter("value <> ''").groupBy("field_id").count().collect()
    assert {"remedy", "both_texts", "finding", "remark"} <= {r["field_id"] for r in cleaned}


def test_repeats_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", 1, "x"), ("a", 2, "x"), ("b", 1, None)], [("a", 3, "x"), ("a", 4, "y"), ("b", 2, None), ("b", 3, "z")])):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("s", "n", "p"), r))) for r in rows))
        os.utime(tmp_path / f"in/{k}.json", (1000 + k, 1000 + k))
    events = spark.readStream.schema("s string, n int, p string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    made = queue.without_repeats(events, "s", "n", "p").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert made.awaitTermination(120)
    assert sorted((r["s"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 4), ("b", 1), ("b", 3)]


def test_streams(spark, tmp_path):
    line = {"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["22380"], "rec_scores": [0.9], "rec_boxes": [[60, 70, 300, 140]]}}]}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(line))
    results = spark.readStream.schema(f"result {ocr.RESULT}").json(str(tmp_path / "in"))
    to_blocks = lambda batch: ocr.blocks(batch.select(F.lit("a").alias("page_id"), F.lit(1).alias("record_no"), "result"))
    fields = catalog.from_fields(spark, catalog.SAMPLE[:1])
    query = queue.inspect_stream(results, to_blocks, fields, Settings(page_width=700, page_height=140), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(90)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["summary"]["field_count"] == 1 and row["page_id"] == "a"


def _ask(prompt):
    """A model that knows fields by name: one is slow, one breaks, one mumbles."""
    shown = {f["id"]: f for f in json.loads(prompt[len(asking.INSTRUCTION) :])}
    if "slow" in shown:
        time.sleep(30)
    if "broken" in shown:
        raise RuntimeError("no service")
    if "mumbled" in shown:
        return "I can't say"
    return "```json\n" + json.dumps({"fields": {k: {"value": "1234", "confidence": "0.9", "needs_review": False, "reason": ""} for k in shown if k != "unsaid"}}) + "\n```"


def test_a_slow_model_leaves_local_values(spark):
    """What comes in time replaces local values; sections that are late, break or can't be read keep theirs, and the page is not held up."""
    names = ["fine", "unsaid", "slow", "broken", "mumbled"]
    fields = catalog.from_fields(spark, [field(n, "digit_length", params={"allow_lengths": [4]}) | {"section": "fine" if n == "unsaid" else n} for n in names])
    found = blocks(spark, ("12", 0.9, (10, 10, 60, 60)))
    settings = Settings(page_width=100, page_height=100)
    rows = clean.local_clean(found.select("page_id"), fields, match.match(found, fields, settings))
    made = {r["field_id"]: r for r in clean.overlay(rows, asking.cleaner(_ask, asking.Budget(call_s=1.0, page_s=5.0))(rows)).collect()}
    took = {r["section"]: (r["timed_out"], r["duration_ms"]) for r in asking.asked(asking.prompts(rows), _ask, asking.Budget(call_s=1.0, page_s=5.0)).collect()}
    assert took["slow"][0] and took["slow"][1] < 4000 and not took["fine"][0]
    assert {k: r["value"] for k, r in made.items()} == {"fine": "1234", "unsaid": "12", "slow": "12", "broken": "12", "mumbled": "12"}
    assert made["fine"]["confidence"] == 0.9 and not made["fine"]["needs_review"]
    assert all(made[k]["review_reason"] == clean.SLOW_REASON for k in ("slow", "broken", "mumbled")) and made["fine"]["review_reason"] == ""


def test_budgets_of_calls_and_pages():
    slow = lambda p: time.sleep(float(p)) or p
    got = asking._page(["5", "0", "0.1", "5"], slow, asking.Budget(call_s=0.5, page_s=30, at_once=1))
    assert [(a, e, late) for a, e, late, _ in got] == [(None, asking.SLOW, True), ("0", None, False), ("0.1", None, False), (None, asking.SLOW, True)]
    began = time.time()
    got = asking._page(["9", "9", "0"], slow, asking.Budget(call_s=20, page_s=0.3, at_once=2))
    assert [e for _, e, _, _ in got] == [asking.OUT_OF_TIME] * 3 and time.time() - began < 2
    assert asking._page([], slow, asking.Budget()) == []
    most, now, lock = [0], [0], threading.Lock()

    def counted(p):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return p

    assert [a for a, *_ in asking._page(list("abcdef"), counted, asking.Budget(at_once=2))] == list("abcdef") and most[0] == 2


def test_answers_are_cached(spark):
    settings, cache = Settings(), spark.createDataFrame([], "key string, answer string, cached_at double")
    wanted = spark.createDataFrame([(1, "a", "p"), (1, "late", "q"), (2, "a", "p"), (2, "bad", None)], "page_id bigint, section string, prompt string")

    def ask(prompt):
        if prompt == "q":
            time.sleep(20)
        if not prompt:
            raise ValueError("nothing to ask")
        return prompt.upper()

    through = lambda cache, now: asking.through_cache(wanted, cache, ask, asking.Budget(call_s=0.5), settings, now, "p", "m")
    answers, new = through(cache, 1000.0)
    assert {(r["page_id"], r["section"]): (r["answer"], r["timed_out"]) for r in answers.collect()} == {(1, "a"): ("P", False), (1, "late"): (None, True), (2, "a"): ("P", False), (2, "bad"): (None, False)}
    saved = spark.createDataFrame(new.collect(), new.schema)
    assert sorted((r["answer"] or "", r["cached_at"]) for r in saved.collect()) == [("", 1000.0), ("P", None)]
    hit = lambda now: {(r["page_id"], r["section"]): r["cache_hit"] for r in through(saved, now)[0].collect()}
    assert hit(1001.0) == {(1, "a"): True, (1, "late"): True, (2, "a"): True, (2, "bad"): False} and not hit(99999.0)[(1, "late")]


def test_of_several_readings_one_counts(spark):
    made = checks(spark, (field("apu", "number_less_than", label="23 APU", params={"max": 99999}, roi_review_always=True), "348", True, True, 0.9))
    planned = review.budgeted(made, Settings())
    two = [("p", "apu", "3481", None, 0.9, "v", "m", None), ("p", "apu", "3482", None, 0.8, "v", "m", None), ("p", "apu", None, None, 0.99, "v", "m", "unread")]
    rows = spark.createDataFrame(two, READING)
    assert [r["value"] for r in review.merge(planned, rows, Settings()).collect()] == ["3481"]
    later = rows.withColumn("seq", F.when(F.col("value") == "3482", 2).otherwise(1))
    assert [r["value"] for r in review.merge(planned, later, Settings()).collect()] == ["3482"]
    local = spark.createDataFrame([("p", "apu", "1", "1", 0.5, False, "")], "page_id string, field_id string, value string, normalized_value string, confidence double, needs_review boolean, review_reason string")
    assert [r["value"] for r in clean.overlay(local, later).collect()] == ["3482"]


def test_leases_run_out_without_an_event(spark, tmp_path):
    """The stream's states after its timers are those of the batch: current, then recover_stale."""
    now, settings = time.time(), Settings(lease_s=60)
    rows = [("old", "created", now - 900), ("old", "claimed", now - 800), ("live", "created", now - 90), ("live", "claimed", now - 20), ("renewed", "claimed", now - 500), ("renewed", "progress", now - 5)]
    rows += [("done", "claimed", now - 700), ("done", "done", now - 600), ("new", "created", now - 1), ("twice", "claimed", now - 900), ("twice", "recovered", now - 500), ("twice", "claimed", now - 400)]
    events = spark.createDataFrame(rows, "task_id string, kind string, at double")
    events.write.parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r["task_id"]] = (r["status"], r["attempt_count"], r["lease_expires_at"] is not None)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        run = task_changes(stream, settings).writeStream.outputMode("update").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
        until = time.time() + 90
        while time.time() < until and not {"old", "twice"} <= {k for k, v in seen.items() if v[0] == "pending"}:
            assert run.isActive, run.exception()
            time.sleep(0.5)
        run.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    full = events
    for c in [f.split()[0] for f in tasks.EVENTS.split(", ") if f.split()[0] not in events.columns]:
        full = full.withColumn(c, F.lit(None).cast("string"))
    batch = tasks.recover_stale(tasks.current(full, settings), now).collect()
    assert {r["task_id"]: (r["status"], r["attempt_count"]) for r in batch} == {k: v[:2] for k, v in seen.items()}
    assert seen["live"][2] and seen["renewed"][2] and not seen["old"][2]


def test_a_tail_reads_few_files(spark, tmp_path):
    """The newest days' files are enough; the lines are those of a tail over the whole log."""
    for day in range(1, 31):
        rows = [(f"2024-01-{day:02d}T{k:02d}:00:00", "info", "e", "a" if k % 5 == 0 else "b", {"n": str(day * 100 + k)}) for k in range(20)]
        logs.write(spark.createDataFrame(rows, "ts string, level string, event string, task_id string, payload map<string,string>").coalesce(1), str(tmp_path))
    numbers = lambda rows: [int(r["payload"]["n"]) for r in rows.collect()]
    for limit, ids, most in ((5, {}, 1), (30, {}, 3), (10, {"task_id": "a"}, 3), (1000, {"task_id": "a"}, 30), (3, {"task_id": "none"}, 30)):
        found = logs.tail_of(spark, str(tmp_path), limit, **ids)
        assert len(found.inputFiles()) <= most
        every = [d * 100 + k for d in range(1, 31) for k in range(20) if not ids or (ids["task_id"] == "a" and k % 5 == 0)]
        assert numbers(found) == every[-limit:]
    (tmp_path / "none").mkdir()
    assert logs.tail_of(spark, str(tmp_path / "none")).count() == 0


def test_a_cache_table_stays_where_it_lies(spark):
    name, settings = f"cache_{os.getpid()}", Settings()
    result = "key string, answer string, value string, normalized_value string, error string, timed_out boolean"
    results = spark.createDataFrame([(f"k{k}", f"a{k}", "v", None, None, k % 10 == 0) for k in range(200)], result)
    for _ in range(2):
        caches.save_table(results, 1000.0, settings, name, 4)
    cache = spark.table(name)
    assert cache.count() == 200 == cache.select("key").distinct().count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("k1",), ("k999",)], "key string").repartition(3)
        missed = caches.misses(asked, spark.table(name))
        assert [r["key"] for r in missed.collect()] == ["k999"]
        plan = missed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scan = plan[: plan.rindex("FileScan")].split("SortMergeJoin")[-1]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(key") == 1 and "Exchange" not in scan.split("\n")[-2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    caches.save_table(results.filter("key = 'k10'").withColumn("timed_out", F.lit(False)), 1001.0, settings, name, 4)
    assert spark.table(name).filter("key = 'k10'").count() == 2
    assert {r["cached_at"] for r in spark.table(name).filter("key = 'k20'").collect()} == {1000.0}
    caches.compact(spark, 1002.0, settings, name, 4)
    assert spark.table(name).count() == 200 and spark.table(name).filter("key = 'k10'").first()["cached_at"] is None
    caches.compact(spark, 9999.0, settings, name, 4)
    assert spark.table(name).count() == 181
    spark.sql(f"DROP TABLE {name}")


def test_many_forms_are_matched_by_cell(spark):
    """The same pairs by cells as by the broadcast join, on boxes that touch, hang over edges and have no area; no nested loop in the plan."""
    rng = random.Random(12)
    side = lambda: rng.choice([0, 1, 40, 159, 160, 161, 700])
    made = []
    for k in range(60):
        extra = rng.choice([{}, {"expand": 0.0}, {"expand": 1.5}])
        made.append(field(f"f{k:02d}", bbox=(rng.choice([0, 160, 320, rng.randrange(2300)]), rng.choice([0, 160, rng.randrange(1700)]), side(), side()), **extra))
    fields = catalog.from_fields(spark, made)
    spots = [(f"t{k}", 0.5, (x, y, x + side(), y + side())) for k in range(150) for x, y in [(rng.choice([0, 160, 320, rng.randrange(2300)]), rng.choice([0, 160, rng.randrange(1700)]))]]
    found = blocks(spark, *spots).unionByName(blocks(spark, *spots[:20], page="q"))
    shown = lambda m: sorted((r["page_id"], r["field_id"], r["block_seq"], r["overlap"], r["near"], r["distance"]) for r in m.collect())
    one, other = match.spatial_match(found, fields, Settings(), False), match.spatial_match(found, fields, Settings(), True)
    assert len(shown(one)) > 300 and shown(one) == shown(other)
    assert "NestedLoop" not in other._jdf.queryExecution().executedPlan().toString() and "NestedLoop" in one._jdf.queryExecution().executedPlan().toString()
    named = fields.withColumn("template_id", F.col("field_seq") % 2), found.withColumn("template_id", F.col("block_seq") % 2)
    one, other = (match.spatial_match(named[1], named[0], Settings(), way) for way in (False, True))
    assert shown(one) == shown(other) and 0 < one.count() < 300 + len(spots) * 60 and one.filter("field_seq % 2 <> block_seq % 2").count() == 0


def test_a_stream_is_written_once(spark, tmp_path):
    """A batch that is done again, as after a failure between writing and committing, changes nothing."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        queue.write_once(stream, out, state).awaitTermination()
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    queue.write_once(spark.readStream.schema("id long").parquet(source), out, state).awaitTermination()
    assert sorted(r["id"] for r in queue.written(spark, out).collect()) == list(range(30))


def test_scores_stay_out_of_the_join(spark):
    """The join of blocks and fields asks for geometry and labels alone: no text is matched or cast for each pair that is tried."""
    made = match.match(spark.createDataFrame([("p", 1, "b", "7", 0.5, 0.0, 0.0, 9.0, 9.0)], "page_id string, block_seq long, block_id string, text string, score double, x1 double, y1 double, x2 double, y2 double"), catalog.from_fields(spark, catalog.SAMPLE), Settings())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "recognizer" in line]
    assert joins and not any(word in line for line in joins for word in ("RLIKE", "array_contains", "validator", "f_number"))


def test_models_are_held_against_checks_that_are_worked_out_once(spark):
    from inkgrid.operators import profile

    checks = spark.createDataFrame([(1, "a", "text", True), (1, "b", "checkbox", False), (2, "c", None, True)], "page_id long, field_id string, recognizer string, passed boolean").repartition(3)
    models = spark.createDataFrame([("m",), ("n",)], "model_name string")
    made = profile.model_matrix(checks, models)
    assert made.columns == [*checks.columns, "model_name"]
    assert sorted(tuple(r) for r in made.select("field_id", "model_name").collect()) == [("a", "m"), ("a", "n"), ("b", "vision-rule")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition ") == 1 and "CartesianProduct" not in made._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_review_merge_works_checks_out_once(spark):
    from inkgrid import registry

    plan = _final_plan(registry.QUERIES["review_merge"](spark, "/root/testdata/sf0.001"))
    assert plan.count("LeftSemi") == 1


def test_texts_are_looked_at_only_where_fields_are(spark):
    from inkgrid import registry

    plan = _final_plan(registry.QUERIES["spatial_match"](spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.split("\n") if "BroadcastNestedLoopJoin" in line]
    assert any("LeftSemi" in j for j in joins)
    assert not any("target" in j for j in joins), "a field's ends are worked out for each field, not for each pair"


def test_cheap_text_patterns(spark):
    cases = ["", " ", "1", "1.", ".5", "1e5", "-1d", "0x1p3", "inf", "-Infinity", "NaN", "AMM123", "2024.01.02", "\t7\x00", "1_0", "+", "1e", "٣", "infinit"]
    numbers = spark.createDataFrame([(k,) for k in cases], "c string").select(F.col("c").try_cast("double").isNotNull().alias("a"), F.col("c").rlike(t.DOUBLE).alias("b")).collect()
    assert all(r.a == r.b for r in numbers)
    blank = spark.createDataFrame([(f"a{k}b、／：中{k}",) for k in [*t.SPACE, "​", "﻿", ""]], "c string").select(t.compact(F.col("c")).alias("v")).collect()
    assert {r.v for r in blank} == {"ab、/:中", "a​b、/:中​", "a﻿b、/:中﻿"}


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_worked_out_once(spark):
    fields = catalog.from_fields(spark, [field("n", "prefix_or_exact", params={"prefixes": ["WB"], "allow_exact": ["N/A"]}), field("m", "exact_text", params={"allow": ["N/A", "渝"]}), field("o", "name_not_place", value_type="signature")])
    found = blocks(spark, ("wb 7", 0.9, (0, 0, 60, 40)), (" n／a", 0.8, (40, 0, 100, 40)), ("Chong Qing", 0.7, (0, 50, 100, 90)), ("SIGN", 0.9, (0, 50, 100, 90)), (None, 0.5, (0, 0, 90, 90)), ("李冬", 0.9, (500, 500, 600, 600)))
    made = match.scored(match.spatial_match(found, fields, Settings(page_width=100, page_height=100)))
    assert _optimized(made.select("page_id", "cand_score")).count("AMM|TSM|FLA") == 1
    got = {(r["field_id"], r["text"], round(r["pattern"], 2)) for r in match.spatial_match(found, fields, Settings(page_width=600, page_height=600)).collect()}
    assert got == {("n", "wb 7", 1.0), ("n", " n／a", 1.0), ("n", "Chong Qing", 0.0), ("n", "", 0.0), ("m", " n／a", 1.0), ("m", "Chong Qing", 1.0), ("o", "wb 7", 0.6), ("o", " n／a", 0.6), ("o", "", 0.0)}


def test_reasons_round_halves_up(spark):
    fields = catalog.from_fields(spark, [field("n", "optional", bbox=(0, 0, 100, 100))])
    made = match.scored(match.spatial_match(blocks(spark, ("x", 0.9, (60, 0, 380, 10)), ("y", 0.9, (0, 0, 1000, 1000))), fields, Settings(page_width=1040, page_height=1040)))
    assert {r["text"]: r["reason"] for r in made.collect()} == {"x": "overlap=0.13", "y": "overlap=0.01"}


def test_catalogue_columns_go_where_nothing_asks_for_them(spark):
    fields = catalog.from_fields(spark, [field("a", "present"), field("b", "digit_length", params={"allow_lengths": [2]})])
    found = blocks(spark, ("12", 0.9, (10, 10, 60, 60)), ("　x y ", 0.8, (20, 20, 70, 70)))
    settings = Settings(page_width=100, page_height=100)
    local = clean.local_clean(found.select("page_id"), fields, match.match(found, fields, settings))
    # Behind the fences; the catalogue itself, a relation of rows, names all of them.
    generated = [line for line in _optimized(triage.with_risk(review.budgeted(rules.validate(local, settings), settings).withColumns({"reviewed": F.lit(False), "changed": F.lit(False), "review_skipped": F.lit(False)})).select("page_id", "field_id", "risk")).splitlines() if "Generate inline" in line]
    assert generated and not any("fail_msg" in line or "forbidden" in line and "Window" in line or "bbox" in line for line in generated)
    assert {r["field_id"]: (r["value"], r["normalized_value"], len(r["cands"])) for r in local.collect()} == {"a": ("12", "12", 2), "b": ("12", "12", 1)}
    none = clean.local_clean(spark.createDataFrame([("q",), ("q",), (None,)], "page_id string"), fields, match.match(found, fields, settings)).filter("page_id is null or page_id = 'q'").collect()
    assert [(r["value"], list(r["cands"])) for r in none] == [("", [])] * 4


@pytest.mark.parametrize("text", [" N-a ", "重 庆", "Chong King", "a：B／c", "", "　", None])
def test_comparable_of_a_compact_text(spark, text):
    row = spark.createDataFrame([(text,)], "c string").select(t.comparable_bare(t.compact(F.col("c"))).alias("a"), F.lower(t.compact(t.exact_value(F.col("c")))).alias("b")).first()
    assert row["a"] == row["b"]
