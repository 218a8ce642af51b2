"""The field catalogue: what a form has, where, and by which rule a value is judged."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import text

BOX = "struct<x:int,y:int,w:int,h:int>"
SCHEMA = (
    f"field_seq int, field_id string, label string, section string, bbox {BOX}, recognizer string, validator string, "
    "params struct<min:double,max:double,allow:array<string>,not_allow:array<string>,prefixes:array<string>,allow_exact:array<string>,"
    "pattern:string,allow_lengths:array<int>,min_letters:int,min_cjk:int>, fail_msg string, "
    f"assignment struct<search_bbox:{BOX},expand:double,value_type:string,`row`:string,needs_review:boolean,roi_review:boolean,"
    "roi_review_always:boolean,prefer_roi_vlm:boolean,skip_roi_review:boolean,evidence_bbox:string,roi_expand:double,"
    "ambiguity_review:boolean,ambiguity_score_ratio:double>"
)
_PARAMS = ("min", "max", "allow", "not_allow", "prefixes", "allow_exact", "pattern", "allow_lengths", "min_letters", "min_cjk")
_ASSIGNMENT = (
    "search_bbox", "expand", "value_type", "row", "needs_review", "roi_review", "roi_review_always", "prefer_roi_vlm", "skip_roi_review", "evidence_bbox", "roi_expand",
    "ambiguity_review", "ambiguity_score_ratio",
)
_DOUBLES = {"min", "max", "expand", "roi_expand", "ambiguity_score_ratio"}

# The form's oil row, left to right, by whose order a row of bare numbers is read.
OIL_ROW = ("oil_eng1_added", "oil_eng1_qty", "oil_eng2_added", "oil_eng2_qty", "oil_apu_added")
OIL_QUANTITIES = ("oil_eng1_qty", "oil_eng2_qty")


def _struct(found: dict, names: tuple[str, ...]) -> tuple:
    return tuple(tuple(v) if n == "search_bbox" and v else float(v) if n in _DOUBLES and v is not None else v for n in names for v in (found.get(n),))


def rows(fields: list[dict]) -> list[tuple]:
    """Catalogue entries as rows of SCHEMA; a missing message says that the label does not comply."""
    return [
        (k, f["id"], f["label"], f["section"], tuple(f["bbox"]), f["recognizer"], f["validator"], _struct(f.get("params") or {}, _PARAMS), f.get("fail_msg") or f"{f['label']}不符合要求", _struct(f.get("assignment") or {}, _ASSIGNMENT))
        for k, f in enumerate(fields)
    ]


def from_fields(spark: SparkSession, fields: list[dict]) -> DataFrame:
    """The catalogue as a DataFrame, with allowed and forbidden values in comparable form. Tens of rows: safe to broadcast."""
    df = spark.createDataFrame(rows(fields), SCHEMA)
    comparable = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), text.comparable)
    forbidden = F.coalesce(F.col("params.not_allow"), F.array(*[F.lit(x) for x in ("重庆", "渝", "chongqing")]))
    lengths = F.coalesce(F.col("params.allow_lengths"), F.array().cast("array<int>"))
    return df.withColumns(
        {
            "allowed": comparable(F.col("params.allow")),
            "forbidden": comparable(forbidden),
            "allowed_exact": F.transform(comparable(F.col("params.allow_exact")), F.upper),
            "prefixes": F.transform(F.coalesce("params.prefixes", F.array().cast("array<string>")), F.upper),
            "lengths": lengths,
            "max_digits": F.when((F.col("validator") == "digit_length") & (F.size(lengths) > 0), F.array_max(lengths))
            .when(F.col("validator") == "number_less_than", F.length((F.coalesce("params.max", F.lit(999999.0)).cast("long") - 1).cast("string")))
            .otherwise(F.lit(6)),
            "enough_digits": F.when((F.col("validator") == "digit_length") & (F.size(lengths) > 0), F.array_min(lengths)).otherwise(F.lit(4)),
            "target": F.coalesce("assignment.search_bbox", "bbox"),
        }
    )


def from_yaml(spark: SparkSession, document: str) -> tuple[DataFrame, tuple[int, int]]:
    """The catalogue in a YAML document (`canonical` size and `fields`), and the page size its boxes are drawn on."""
    data = yaml.safe_load(document)
    size = data.get("canonical") or {}
    return from_fields(spark, data["fields"]), (size.get("width", 2400), size.get("height", 1784))


def field(id: str, label: str, section: str, bbox: tuple, recognizer: str, validator: str, fail_msg: str, search: tuple, params: dict | None = None, **assignment) -> dict:
    return {"id": id, "label": label, "section": section, "bbox": bbox, "recognizer": recognizer, "validator": validator, "fail_msg": fail_msg, "params": params or {}, "assignment": {"search_bbox": search, **assignment}}


def _cell(column: int, row: int, wide: int = 1) -> dict:
    """Box and search box of cells of a grid of six columns and five rows over the page."""
    x, y, w = 40 + 390 * column, 50 + 345 * row, 390 * wide - 50
    return {"bbox": (x, y, w, 260), "search": (max(0, x - 35), max(0, y - 45), w + 70, 345)}


def _sample() -> list[dict]:
    """An invented equipment sheet: every rule and kind of value once or more."""
    number = {"recognizer": "numeric_text", "value_type": "numeric"}
    keyed, free = {"recognizer": "keyed_text"}, {"recognizer": "free_text", "value_type": "free_text"}
    added, level = {"min": 1, "max": 6}, {"min": 18, "max": 28}
    oil = [
        field(id, f"B{k + 1} {label}", "oil", validator="int_range", fail_msg=f"{label}超出范围", params=params, row="last", **_cell(k, 1), **number)
        for k, (id, label, params) in enumerate(zip(OIL_ROW, ("左侧加油", "左侧油位", "右侧加油", "右侧油位", "APU加油"), (added, level, added, level, added)))
    ]
    return [
        field("asset_tag", "A1 设备编号", "asset", validator="digit_length", fail_msg="设备编号位数不对", params={"allow_lengths": [5, 6]}, roi_review=True, **_cell(0, 0), **number),
        field("site", "A2 所在地", "asset", validator="exact_text", fail_msg="所在地不在名单内", params={"allow": ["重庆", "渝", "Chongqing"]}, value_type="closed", **_cell(1, 0), **keyed),
        field("shift_code", "A3 班次", "asset", validator="exact_text", fail_msg="班次应为空缺", params={"allow": ["N/A", "NA"]}, value_type="closed", **_cell(2, 0), **keyed),
        field("ready_box", "A4 可用勾选", "asset", recognizer="checkbox", validator="checked", fail_msg="可用一栏没有勾选", **_cell(3, 0)),
        field("holder", "A5 保管人签名", "asset", recognizer="signature_or_text", validator="name_not_place", fail_msg="保管人没有签名", params={"not_allow": ["重庆", "渝", "Chongqing"]}, value_type="signature", prefer_roi_vlm=True, **_cell(4, 0, 2)),
        *oil,
        field("spare_note", "B6 备件", "oil", validator="optional", fail_msg="备件", value_type="text", **_cell(5, 1), **keyed),
        field("job_ref", "C1 依据", "work", validator="prefix_or_exact", fail_msg="依据文件不明", params={"prefixes": ["AMM", "TSM"], "allow_exact": ["N/A"]}, value_type="ref", **_cell(0, 2), **keyed),
        field("done_on", "C2 完成日期", "work", recognizer="date_text", validator="same_day", fail_msg="完成日期不是当日", value_type="date", **_cell(1, 2)),
        field("permit", "C3 授权号", "work", validator="regex", fail_msg="授权号不是六位数字", params={"pattern": text.AUTHORIZATION_PATTERN}, value_type="authorization", needs_review=True, **_cell(2, 2), **keyed),
        field("finding", "C4 发现", "work", validator="contains_english", fail_msg="发现一栏缺英文", **_cell(3, 2, 3), **free),
        field("remedy", "C5 处理", "work", validator="present", fail_msg="处理一栏空白", **_cell(0, 3, 3), **free),
        field("hours", "D1 APU累计小时", "apu", validator="number_less_than", fail_msg="APU累计小时过大", params={"max": 5000}, roi_review=True, **_cell(3, 3), **number),
        field("starts", "D2 APU启动次数", "apu", validator="number_less_than", fail_msg="APU启动次数过大", params={"max": 400}, roi_review_always=True, **_cell(4, 3), **number),
        field("remark", "E1 英文备注", "handover", recognizer="free_text", validator="english_text", fail_msg="备注不是英文", **_cell(5, 3)),
        field("both_texts", "E2 双语小结", "handover", validator="bilingual_text", fail_msg="小结不是双语", params={"min_letters": 3, "min_cjk": 2}, **_cell(0, 4, 3), **free),
        field("licence", "E3 执照号", "handover", validator="regex", fail_msg="执照号格式不对", params={"pattern": text.LICENSE_PATTERN}, value_type="license", needs_review=True, **_cell(3, 4, 2), **keyed),
        field("witness", "E4 见证人", "handover", validator="name_not_place", fail_msg="没有见证人", **_cell(5, 4), **keyed),
    ]


SAMPLE = _sample()


def of_fields(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the fields asked for (field_id), each once however often it is asked for."""
    return rows.join(wanted.select("field_id"), "field_id", "left_semi")
