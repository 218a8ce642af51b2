"""The core queries over the driver's tables, each with its SQL where SQL can say it in reason."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid import oracle as o
from inkgrid.config import Settings
from inkgrid.functions import text as t
from inkgrid.functions.once import computed_once, dealt, spread
from inkgrid.operators import asking, caches, clean, homography, layout, logs, match, policies, profile, report, resolve, review, rules, tasks, triage
from inkgrid.plans import inspection
from inkgrid.sources import catalog, jobs, ocr, scans, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SETTINGS = Settings(today=o.TODAY, review_limit=6)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_held: dict[str, DataFrame] = {}


def _fields(spark: SparkSession) -> DataFrame:
    """The sample catalogue, worked out once in a session: some tens of rows."""
    session = spark.sparkContext.applicationId
    if session not in _held or _held[session].sparkSession is not spark:
        made = catalog.from_fields(spark, catalog.SAMPLE)
        _held[session] = spark.createDataFrame(made.collect(), made.schema)
    return _held[session]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.spatial_match(tables.form_blocks(spark, sf_dir), _fields(spark), SETTINGS)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_conflicts(match.match(tables.form_blocks(spark, sf_dir), _fields(spark), SETTINGS))


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.form_blocks(spark, sf_dir).select("page_id")
    return inspection.checked(pages, _fields(spark), _resolved(spark, sf_dir), SETTINGS)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.budgeted(_checks(spark, sf_dir), SETTINGS)


def _unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned checks as they stand without second readings."""
    return _planned(spark, sf_dir).withColumns({"reviewed": F.lit(False), "changed": F.lit(False), "review_skipped": F.col("eligible") & ~F.col("selected")})


def _r(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


@query(f"WITH {o.BLOCKS}, {o.EXTENT} SELECT page_id, page_w, page_h FROM extent")
def page_extent(spark, sf_dir):
    return match.page_extent(tables.form_blocks(spark, sf_dir))


@query(f"WITH {', '.join([o.BLOCKS, o.EXTENT, o.fields(), o.FACTS, o.PAIRS])} SELECT page_id, field_id, block_seq, round(overlap, 6) AS overlap, near, round(distance, 6) AS distance, pattern_score AS pattern FROM kept")
def spatial_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", "field_id", "block_seq", _r("overlap"), "near", _r("distance"), "pattern")


@query(f"{o.UPTO_TOP} SELECT page_id, field_id, rank, block_seq, round(cand_score, 6) AS cand_score FROM top8")
def candidate_top8(spark, sf_dir):
    found = match.match(tables.form_blocks(spark, sf_dir), _fields(spark), SETTINGS)
    return found.select("page_id", "field_id", F.col("rank").cast("long").alias("rank"), "block_seq", _r("cand_score"))


@query(f"{o.UPTO_RESOLVED} SELECT page_id, field_id, rank, block_seq, round(cand_score, 6) AS cand_score FROM resolved")
def conflict_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("page_id", "field_id", F.col("rank").cast("long").alias("rank"), "block_seq", _r("cand_score"))


_NEAR = "near AS (SELECT * REPLACE (CASE WHEN o THEN x1 ELSE 150 + x1 % 650 END AS x1, CASE WHEN o THEN y1 ELSE 580 + y1 % 100 END AS y1, CASE WHEN o THEN x2 ELSE 190 + x1 % 650 END AS x2, CASE WHEN o THEN y2 ELSE 600 + y1 % 100 END AS y2) FROM (SELECT *, block_seq % 5 = 0 AS o FROM blocks))"


@query(f"WITH RECURSIVE {o.BLOCKS}, {_NEAR}, {o.oil_row('near')} SELECT page_id, field_id, block_seq, text FROM oil_row")
def row_sequence(spark, sf_dir):
    """The oil row of forms whose blocks lie close together."""
    blocks = tables.form_blocks(spark, sf_dir)
    near = {"x1": 150 + F.col("x1") % 650, "y1": 580 + F.col("y1") % 100, "x2": 190 + F.col("x1") % 650, "y2": 600 + F.col("y1") % 100}
    blocks = blocks.withColumns({c: F.when(F.col("block_seq") % 5 == 0, F.col(c)).otherwise(v) for c, v in near.items()})
    return resolve.oil_row(blocks, _fields(spark), SETTINGS).select("page_id", "field_id", "block_seq", "text")


@query(f"{o.UPTO_FULL} SELECT page_id, field_id, rank, block_seq, round(cand_score, 6) AS cand_score, reason FROM complete")
def full_candidates(spark, sf_dir):
    """Candidates with the oil row put in front."""
    return inspection.candidates_of(tables.form_blocks(spark, sf_dir), _fields(spark), SETTINGS).select("page_id", "field_id", "rank", "block_seq", _r("cand_score"), "reason")


@query(f"{o.UPTO_CHECKS} SELECT page_id, field_id, value, normalized_value, round(confidence, 6) AS confidence, needs0 AS needs_review FROM messaged")
def local_clean(spark, sf_dir):
    pages = tables.form_blocks(spark, sf_dir).select("page_id")
    rows = clean.local_clean(pages, _fields(spark), _resolved(spark, sf_dir))
    return rows.select("page_id", "field_id", "value", "normalized_value", _r("confidence"), "needs_review")


@query(f"{o.UPTO_CHECKS} SELECT page_id, field_id, {o.merged()} AS digits FROM messaged WHERE validator IN ('digit_length', 'number_less_than') AND len(cs) > 0")
def digit_merge(spark, sf_dir):
    rows = clean.gathered(_resolved(spark, sf_dir)).join(F.broadcast(_fields(spark)), "field_id").filter(F.col("validator").isin("digit_length", "number_less_than"))
    return rows.select("page_id", "field_id", clean.merged_digits(F.col("cands")).alias("digits"))


def _rule_query(name: str, field_id: str) -> None:
    def run(spark, sf_dir):
        blocks = tables.form_blocks(spark, sf_dir).select("block_seq", "text")
        field = F.broadcast(_fields(spark).filter(F.col("field_id") == field_id))
        value = t.normalized(F.col("text"))
        return blocks.crossJoin(field).select("block_seq", F.coalesce(rules.REGISTRY[name](value, SETTINGS), F.lit(False)).alias("passed"))

    run.__name__ = f"rule_{name}"
    v = o.norm("text")
    query(f"WITH {o.BLOCKS}, {o.fields()} SELECT block_seq, coalesce({o.rule_sql(v)[name]}, FALSE) AS passed FROM blocks, fields WHERE field_id = '{field_id}'")(run)


for _f in {f["validator"]: f["id"] for f in reversed(catalog.SAMPLE)}.items():
    _rule_query(*_f)


@query(f"{o.UPTO_CHECKS} SELECT page_id, field_id, passed, message, needs_review, review_reason FROM messaged")
def validated(spark, sf_dir):
    return _checks(spark, sf_dir).select("page_id", "field_id", "passed", "message", "needs_review", "review_reason")


@query(
    "SELECT o_orderkey, s, " + o.date("s") + " AS normal FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') "
    "WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN 'on ' || strftime(o_orderdate, '%Y') || ' - ' || strftime(o_orderdate, '%m.%d') ELSE o_orderpriority END AS s FROM orders)"
)
def normalize_date(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy.MM.dd")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "yyyyMMdd"))
        .when(k == 4, F.concat(F.lit("on "), F.date_format(d, "yyyy"), F.lit(" - "), F.date_format(d, "MM.dd"))).otherwise(F.col("o_orderpriority"))
    )
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("s")).withColumn("normal", t.date_text(F.col("s")))


_WORD = "CASE p_partkey % 5 WHEN 0 THEN 'n / a' WHEN 1 THEN ' ChongQing ' WHEN 2 THEN 'N-A' WHEN 3 THEN '渝' ELSE p_name END"


@query(f"SELECT p_partkey, {o.na('s')} AS na, {o.exact('s')} AS exact, {o.comparable('s')} AS comparable FROM (SELECT p_partkey, {_WORD} AS s FROM part)")
def normalize_words(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", F.expr(_WORD).alias("s"))
    return rows.select("p_partkey", t.with_na(F.col("s")).alias("na"), t.exact_value(F.col("s")).alias("exact"), t.comparable(F.col("s")).alias("comparable"))


@query(f"SELECT doc_id, {o.english('text')} AS english FROM documents")
def sanitize_english(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", t.english_only(F.col("text")).alias("english"))


_PRINTED = "CASE doc_id % 6 WHEN 0 THEN text || ' REPORTED BY' WHEN 1 THEN text || ' FINAL signs' WHEN 2 THEN '授权号' || text WHEN 3 THEN text || ' FIN: 2' WHEN 4 THEN 'undated ' || text ELSE text END"


@query(f"SELECT doc_id, {o.label('s')} AS is_label FROM (SELECT doc_id, {_PRINTED} AS s FROM documents)")
def label_noise(spark, sf_dir):
    """Texts with words of the form in them, words that only hold such words, and neither."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", t.is_label(F.expr(_PRINTED)).alias("is_label"))


_SAID = "CASE turn % 7 WHEN 1 THEN 'AMM32-' || conv_id WHEN 2 THEN '2024.01.02' WHEN 3 THEN ' 渝 ' WHEN 4 THEN 'n / a' WHEN 5 THEN text || ' 报告者' WHEN 6 THEN substr(text, 1, 11) ELSE text END"


@query(f"SELECT conv_id, turn, {o.body('s')} AS is_body FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations)")
def body_text(spark, sf_dir):
    """Texts that read like a body, and references, dates, places, labels and short ones."""
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", t.is_body(F.expr(_SAID)).alias("is_body"))


_QUANTITY = "CASE event_id % 4 WHEN 0 THEN ' 7' || CAST(event_id % 10 AS {0}) || '.5' WHEN 1 THEN '7' || CAST(event_id % 10 AS {0}) WHEN 2 THEN CAST(event_id % 97 AS {0}) ELSE '7x' END"
_OIL = "oil_eng1_qty"


@query(f"WITH {o.fields()}, q AS (SELECT event_id, {_QUANTITY.format('VARCHAR')} AS s FROM events) SELECT event_id, {o.repaired('s')} AS repaired, {o.number(o.repaired('s'))} BETWEEN pmin AND pmax AS passed FROM q, fields WHERE field_id = '{_OIL}' AND event_id % 4 < 3")
def oil_repair(spark, sf_dir):
    """Oil quantities, those read 7x for 2x put right where that is in range."""
    field = F.broadcast(_fields(spark).filter(F.col("field_id") == _OIL))
    rows = tables.table(spark, sf_dir, "events").filter("event_id % 4 < 3").select("event_id", F.expr(_QUANTITY.format("string")).alias("s")).crossJoin(field)
    return rows.select("event_id", rules.repaired_range(F.col("s")).alias("repaired"), rules.REGISTRY["int_range"](F.col("s"), SETTINGS).alias("passed"))


@query(f"SELECT event_id, {o.six('s')} AS six FROM (SELECT event_id, event_type || lpad(CAST(event_id AS VARCHAR), 6, '0') || '-' || CAST(event_id * 7 AS VARCHAR) AS s FROM events)")
def authorization_number(spark, sf_dir):
    e = F.col("event_id").cast("string")
    s = F.concat(F.col("event_type"), F.lpad(e, 6, "0"), F.lit("-"), (F.col("event_id") * 7).cast("string"))
    return tables.table(spark, sf_dir, "events").select("event_id", t.last_six_digits(s).alias("six"))


@query(f"{o.UPTO_CHECKS} SELECT page_id, field_id, doubt FROM messaged WHERE doubt <> ''")
def ambiguity(spark, sf_dir):
    rows = clean.gathered(_resolved(spark, sf_dir)).join(F.broadcast(_fields(spark)), "field_id")
    return rows.select("page_id", "field_id", review.ambiguity(F.col("cands")).alias("doubt")).filter("doubt <> ''")


@query(f"{o.UPTO_PLAN} SELECT page_id, field_id, priority, eligible FROM planned")
def review_priority(spark, sf_dir):
    return _planned(spark, sf_dir).select("page_id", "field_id", "priority", "eligible")


@query(f"{o.UPTO_PLAN} SELECT page_id, field_id, review_turn, selected FROM planned WHERE eligible")
def review_budget(spark, sf_dir):
    return _planned(spark, sf_dir).filter("eligible").select("page_id", "field_id", F.col("review_turn").cast("long").alias("review_turn"), "selected")


@query(f"{o.UPTO_PLAN} SELECT page_id, count(*) FILTER (eligible) AS eligible_count, count(*) FILTER (selected) AS selected_count, count(*) FILTER (eligible AND NOT selected) AS skipped_count FROM planned GROUP BY page_id")
def review_plan(spark, sf_dir):
    return review.plan(_planned(spark, sf_dir), SETTINGS).select("page_id", "eligible_count", "selected_count", "skipped_count")


@query(f"{o.UPTO_PLAN},\n{o.MERGED} SELECT * FROM merged")
def review_merge(spark, sf_dir):
    # Planned checks and the readings that are made of them come from one shuffle, with a fence behind it that lets no filter pass, on page_id
    # neither, and so nothing is worked out twice.
    held = dealt(_planned(spark, sf_dir).drop("cands", "target", "bbox"), "page_id", "field_id").withColumnRenamed("page_id", "__page")
    planned = computed_once(held).withColumnRenamed("__page", "page_id")
    zero = F.col("page_id") % 3 == 0
    readings = planned.filter("selected and page_id % 3 < 2").select(
        "page_id", "field_id", F.when(zero, "3").otherwise("2024.01.02").alias("value"), F.lit(None).cast("string").alias("normalized_value"), F.when(zero, 0.9).otherwise(0.5).alias("confidence"),
        F.lit("vlm").alias("provider"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("error"),
    )
    return review.merge(planned, readings, SETTINGS).select("page_id", "field_id", "accepted", "normalized_value", "passed", "needs_review", "review_reason", "changed")


@query(f"{o.UPTO_CHECKS},\n{o.evidence_box(1200, 892)} SELECT page_id, field_id, x, y, w, h FROM boxed")
def evidence_boxes(spark, sf_dir):
    """Image boxes of every field, in images of one size."""
    blocks = tables.form_blocks(spark, sf_dir)
    rows = clean.local_clean(blocks.select("page_id").distinct(), _fields(spark), _resolved(spark, sf_dir)).join(match.page_extent(blocks), "page_id")
    rows = rows.withColumns({"image_w": F.lit(1200), "image_h": F.lit(892)})
    return review.evidence_boxes(rows, SETTINGS)


@query(f"{o.UPTO_ISSUES} SELECT page_id, field_id, risk, CASE WHEN risk >= 130 THEN 'high' WHEN risk >= 80 THEN 'medium' ELSE 'low' END AS risk_level FROM risked")
def risk_score(spark, sf_dir):
    return triage.with_risk(_unread(spark, sf_dir)).select("page_id", "field_id", "risk", "risk_level")


@query(f"{o.UPTO_ISSUES} SELECT page_id, slot, field_id, itext AS text, ikind AS kind FROM shown")
def triage_topk(spark, sf_dir):
    return triage.top_issues(_unread(spark, sf_dir), SETTINGS).select("page_id", F.col("slot").cast("long").alias("slot"), "field_id", "text", "kind")


@query(f"{o.UPTO_ISSUES} SELECT page_id, field_id, itext AS text FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.page_id = r.page_id AND s.itext = r.itext)")
def triage_suppressed(spark, sf_dir):
    return triage.suppressed(_unread(spark, sf_dir), SETTINGS).select("page_id", "field_id", "text")


def _chooser(prompt: str) -> str:
    """Stands for a model: of an odd number of issues it chooses the form's last two, of an even one none."""
    shown = json.loads(prompt.split("\n", 1)[1])
    if len(shown) % 2 == 0:
        return "all is well"
    return json.dumps({"problem_items": [{"field_id": i["id"], "kind": i["kind"], "text": f"look at {i['id']}"} for i in shown[-2:]]})


@query(
    f"""{o.UPTO_ISSUES}, c AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY field_seq DESC) AS place FROM ranked)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY field_seq) AS slot, field_id, 'look at ' || field_id AS text, CASE WHEN ikind = 0 THEN 'failure' ELSE 'review' END AS kind FROM c WHERE n % 2 = 1 AND place <= 2
UNION ALL SELECT page_id, slot, field_id, itext, CASE WHEN ikind = 0 THEN 'failure' ELSE 'review' END FROM shown WHERE page_id NOT IN (SELECT page_id FROM c WHERE n % 2 = 1)"""
)
def model_triage(spark, sf_dir):
    """The issues that a model chose for each page, by rule where it chose none."""
    made = asking.triaged(_unread(spark, sf_dir), _chooser, SETTINGS)
    return made.select("page_id", F.col("slot").cast("long").alias("slot"), "field_id", "text", "kind")


_PROBLEM = "CASE page_id % 4 WHEN 0 THEN '所在地不在名单内' WHEN 1 THEN 'APU累计小时 需要人工确认' WHEN 2 THEN 'nothing of the kind' ELSE '授权号不是六位' END"


@query(
    f"""{o.UPTO_ISSUES}, probs AS (SELECT DISTINCT page_id, {_PROBLEM} AS text FROM blocks),
hits AS (SELECT p.page_id, p.text, r.*EXCLUDE (page_id), regexp_replace(lower(p.text), '\\s+', '', 'g') AS k, regexp_replace(lower(itext), '\\s+', '', 'g') AS own,
  regexp_replace(lower(label), '\\s+', '', 'g') AS lab, regexp_replace(lower(regexp_replace(label, '^[0-9. 、-]+', '')), '\\s+', '', 'g') AS bare FROM probs p LEFT JOIN ranked r ON r.page_id = p.page_id),
steps AS (SELECT *, CASE WHEN k = own OR contains(own, k) OR contains(k, own) THEN 1 WHEN contains(k, lab) OR (bare <> '' AND contains(k, bare)) THEN 2 END AS step FROM hits),
first AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY step NULLS LAST, ikind, field_seq) AS n FROM steps)
SELECT page_id, text, CASE WHEN step IS NULL THEN '' ELSE field_id END AS field_id, CASE WHEN step IS NULL THEN 'summary' WHEN ikind = 0 THEN 'failure' ELSE 'review' END AS kind FROM first WHERE n = 1"""
)
def problem_map(spark, sf_dir):
    pages = tables.form_blocks(spark, sf_dir).select("page_id").distinct()
    problems = pages.select("page_id", F.lit(0).alias("pos"), F.expr(_PROBLEM).alias("text"))
    return triage.attributed(problems, _unread(spark, sf_dir)).select("page_id", "text", "field_id", "kind")


@query(f"{o.UPTO_CHECKS} SELECT page_id, count(*) AS field_count, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count, count(*) FILTER (needs_review) AS review_count, count(*) FILTER (NOT passed AND message <> '') = 0 AS ok FROM messaged GROUP BY page_id")
def form_summary(spark, sf_dir):
    return report.summary(_checks(spark, sf_dir))


@query()
def page_report(spark, sf_dir):
    """The nested document of each form, through the whole plan."""
    return inspection.inspect(tables.form_blocks(spark, sf_dir), _fields(spark), SETTINGS).reports


_FLAT = """f AS (SELECT page_id, string_agg(field_id || ':' || passed || ':' || coalesce(normalized_value, ''), '|' ORDER BY field_seq) AS fields, count(*) AS field_count, count(*) FILTER (passed) AS passed_count,
  count(*) FILTER (NOT passed) AS failed_count, count(*) FILTER (needs_review) AS review_count, count(*) FILTER (NOT passed AND message <> '') = 0 AS ok FROM risked GROUP BY page_id),
p AS (SELECT page_id, string_agg(itext, '|' ORDER BY slot) AS problems FROM shown GROUP BY page_id)
SELECT page_id, ok, field_count, passed_count, failed_count, review_count, coalesce(problems, '通过') AS problems, fields FROM f LEFT JOIN p USING (page_id)"""


def _flat(made: DataFrame) -> DataFrame:
    """Nested documents taken apart."""
    field = F.transform("fields", lambda f: F.concat_ws(":", f["id"], f["passed"].cast("string"), F.coalesce(f["normalized_value"], F.lit(""))))
    return made.select("page_id", "ok", "summary.*", F.array_join("problems", "|").alias("problems"), F.array_join(field, "|").alias("fields"))


@query(f"{o.UPTO_ISSUES}, {_FLAT}")
def form_document(spark, sf_dir):
    """The document of each form; the checks are those before second readings and the row of numbers."""
    return _flat(report.documents(_unread(spark, sf_dir), SETTINGS))


@query(f"{o.UPTO_REPORT}, {_FLAT}")
def report_document(spark, sf_dir):
    """The document of each form through the whole plan: page_report taken apart."""
    return _flat(page_report(spark, sf_dir))


@query(
    f"""{o.UPTO_RESOLVED}, l AS (SELECT page_id, field_id, min(field_seq) AS field_seq, string_agg(block_id || ':' || text || ':' || round(cand_score, 4), ',' ORDER BY rank) AS l FROM resolved GROUP BY page_id, field_id)
SELECT page_id, string_agg(field_id || '=' || l, ';' ORDER BY field_seq) AS listed FROM l GROUP BY page_id"""
)
def candidate_json(spark, sf_dir):
    """The candidates of each form as JSON, read back."""
    made = report.candidates_json(_resolved(spark, sf_dir))
    held = F.map_entries(F.from_json("candidates", "map<string,array<struct<block_id:string,text:string,assignment_score:double>>>"))
    entry = lambda c: F.concat_ws(":", c["block_id"], c["text"], F.round(c["assignment_score"], 4).cast("string"))
    listed = F.transform(held, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], entry), ",")))
    return made.select("page_id", F.array_join(listed, ";").alias("listed"))


@query(f"WITH {o.BLOCKS} SELECT page_id, count(*) AS blocks, {o.FAMILY_COUNTS} FROM blocks GROUP BY page_id")
def family_counts(spark, sf_dir):
    return profile.family_counts(tables.form_blocks(spark, sf_dir))


@query(f"WITH {o.BLOCKS} SELECT block_seq, unnest(list_filter([" + ", ".join(f"CASE WHEN {o.has('text', p)} THEN '{n}' END" for n, p in profile.FAMILIES.items()) + "], lambda x: x IS NOT NULL)) AS family FROM blocks")
def block_families(spark, sf_dir):
    return profile.families(tables.form_blocks(spark, sf_dir)).select("block_seq", "family")


@query("SELECT doc_id, " + ", ".join(f"contains(text, '{p}') AS has_{k}" for k, p in enumerate(profile.PROBES)) + ", contains(lower(text), '<table') AS table_like, CAST(length(text) AS INTEGER) AS chars, substr(text, 1, 500) AS preview FROM documents")
def doc_probes(spark, sf_dir):
    return profile.probes(tables.table(spark, sf_dir, "documents"))


@query(f"WITH {o.BLOCKS}, g AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM blocks) SELECT page_id, block_seq, unnest(list_filter({o.GUESSES}, lambda x: x IS NOT NULL)) AS guess FROM g")
def positional_guess(spark, sf_dir):
    return profile.guessed(tables.form_blocks(spark, sf_dir)).select("page_id", "block_seq", "guess")


_SHOWN = "CASE guess " + " ".join(f"WHEN '{n}' THEN {g[-1]}" for n, g in profile.GUESSES.items()) + " END"


@query(
    f"""WITH {o.BLOCKS}, g AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM blocks), h AS (SELECT page_id, block_seq, text, unnest(list_filter({o.GUESSES}, lambda x: x IS NOT NULL)) AS guess FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, guess ORDER BY block_seq) AS n FROM h), c AS (SELECT page_id, {o.FAMILY_COUNTS} FROM blocks GROUP BY page_id)
SELECT page_id, n_refs, n_dates, fault_ref, awr_date FROM c LEFT JOIN (SELECT page_id, string_agg(text, '|' ORDER BY n) FILTER (guess = 'fault_ref') AS fault_ref, string_agg(text, '|' ORDER BY n) FILTER (guess = 'awr_date') AS awr_date FROM k WHERE n <= {_SHOWN} GROUP BY page_id) USING (page_id)"""
)
def comparison_document(spark, sf_dir):
    """The comparison of recogniser output as JSON, read back."""
    made = profile.comparison(tables.form_blocks(spark, sf_dir))
    held = F.from_json("json", "counts map<string,bigint>, field_guesses map<string,array<struct<text:string>>>")
    shown = lambda name: F.array_join(F.col("h.field_guesses")[name]["text"], "|").alias(name)
    rows = made.withColumn("h", held)
    return rows.select("page_id", F.col("h.counts")["refs"].alias("n_refs"), F.col("h.counts")["dates"].alias("n_dates"), shown("fault_ref"), shown("awr_date"))


_MODELS = (("small",), ("medium",), ("large",))


@query(f"{o.UPTO_CHECKS}, m AS (SELECT * FROM (VALUES ('small'), ('medium'), ('large')) v(model_name)), x AS (SELECT model_name, passed FROM messaged, m WHERE recognizer <> 'checkbox' UNION ALL SELECT 'vision-rule', passed FROM messaged WHERE recognizer = 'checkbox') SELECT model_name, count(*) AS asked, count(*) FILTER (passed) AS passed, round(avg(CAST(passed AS INTEGER)), 9) AS pass_rate FROM x GROUP BY model_name")
def model_matrix(spark, sf_dir):
    made = profile.model_summary(profile.model_matrix(_checks(spark, sf_dir), spark.createDataFrame(_MODELS, "model_name string")))
    return made.select("model_name", "asked", "passed", F.round("pass_rate", 9).alias("pass_rate"))


@query("SELECT event_id AS line_no, event_type AS event, 'u' || user_id AS task_id FROM events WHERE user_id = 7 AND event_id % 3 = 1 ORDER BY event_id DESC LIMIT 200")
def log_tail(spark, sf_dir):
    return logs.tail(tables.logs(spark, sf_dir), 200, task_id="u7", run_id="1").select("line_no", "event", "task_id")


@query("""SELECT event_id AS line_no, map_from_entries([{'k': 'k', 'v': CAST(json_extract_string(props, '$.k') AS VARCHAR)}, {'k': 'Auth_Token', 'v': '[redacted]'}])['k'] AS k, '[redacted]' AS secret FROM events""")
def log_redact_map(spark, sf_dir):
    payload = F.create_map(F.lit("k"), F.get_json_object("payload", "$.k"), F.lit("Auth_Token"), F.col("event"), F.lit("empty"), F.lit(""))
    made = tables.logs(spark, sf_dir).withColumn("m", logs.redacted_map(logs.cleaned(payload)))
    return made.select("line_no", F.col("m")["k"].alias("k"), F.col("m")["Auth_Token"].alias("secret"))


@query("SELECT event_id AS line_no, json_extract_string(props, '$.k') AS k, '[redacted]' AS secret FROM events")
def log_redact_json(spark, sf_dir):
    nested = F.concat(F.lit('{"a": [{"API_KEY_2": 1, "k": '), F.get_json_object("payload", "$.k"), F.lit("}]}"))
    made = tables.logs(spark, sf_dir).withColumn("j", logs.redacted_json(nested))
    return made.select("line_no", F.get_json_object("j", "$.a[0].k").alias("k"), F.get_json_object("j", "$.a[0].API_KEY_2").alias("secret"))


def _model(prompt: str) -> str:
    """Stands for a model: it names each field and its rule, is lost with one section and mumbles at another."""
    shown = json.loads(prompt[len(asking.INSTRUCTION) :])
    if any(f["id"].startswith("oil") for f in shown):
        raise TimeoutError("no answer")
    if any(f["validator"] == "same_day" for f in shown):
        return "not today"
    return json.dumps({"fields": {f["id"]: {"value": f"{f['id']}: {f['validator']}", "confidence": 0.5} for f in shown}})


@query(
    f"""{o.UPTO_CHECKS}, shown AS (SELECT page_id, section, field_id, validator FROM messaged WHERE recognizer <> 'checkbox' AND len(cs) > 0),
s AS (SELECT page_id, section, CASE WHEN bool_or(starts_with(field_id, 'oil')) THEN 'TimeoutError: no answer' WHEN bool_or(validator = 'same_day') THEN 'invalid_cleaner_response' END AS error FROM shown GROUP BY page_id, section)
SELECT page_id, field_id, CASE WHEN error IS NULL THEN field_id || ': ' || validator ELSE '' END AS value, CASE WHEN error IS NULL THEN 0.5 ELSE 0 END::DOUBLE AS confidence, error FROM shown JOIN s USING (page_id, section)"""
)
def model_values(spark, sf_dir):
    """What a model says of each field, or why it said nothing: sections are asked within a budget of time."""
    rows = clean.local_clean(tables.form_blocks(spark, sf_dir).select("page_id"), _fields(spark), _resolved(spark, sf_dir))
    made = asking.values(asking.asked(asking.prompts(rows), _model), rows)
    return made.select("page_id", "field_id", "value", "confidence", "error")


_POINT = "substr(sha256('s' || {0}), 1, {1})"
_WORD64 = "CAST('0x' || substr({0}, {1}, 16) AS UBIGINT)"


@query(
    f"""WITH t AS (SELECT s_suppkey AS k, {_POINT.format('s_suppkey', 64)} AS d FROM supplier), p AS (SELECT user_id AS page_id, event_id AS x, {_POINT.format('(event_id % 13 + 1)', 48)} || substr(sha256('e' || event_id), 1, 16) AS d FROM events),
a AS (SELECT page_id, x, k, CAST({' + '.join(f"CAST(bit_count(xor({_WORD64.format('p.d', i)}, {_WORD64.format('t.d', i)})) AS INTEGER)" for i in (1, 17, 33, 49))} AS INTEGER) AS apart FROM p, t),
n AS (SELECT *, row_number() OVER w AS place, lead(apart) OVER w AS second FROM a WINDOW w AS (PARTITION BY x ORDER BY apart, k))
SELECT page_id, CAST(x AS DOUBLE) AS x, CAST(k AS DOUBLE) AS tx, apart AS distance FROM n WHERE place = 1 AND apart < 0.8 * second"""
)
def keypoint_matches(spark, sf_dir):
    """Keypoints of pages with their match among a template's: descriptors by hash, a quarter of their bits another's."""
    point = lambda k, n: F.substring(F.sha2(F.concat(F.lit("s"), k.cast("string")).cast("binary"), 256), 1, n)
    template = tables.table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").alias("x"), F.lit(0).alias("y"), F.unhex(point(F.col("s_suppkey"), 64)).alias("descriptor"))
    own = F.substring(F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")).cast("binary"), 256), 1, 16)
    events = spread(tables.table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    points = events.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("x"), F.lit(0).alias("y"), F.unhex(F.concat(point(F.col("event_id") % 13 + 1, 48), own)).alias("descriptor"))
    return homography.matches(points, template).select("page_id", "x", "tx", "distance")


@query("SELECT user_id AS task_id, event_id FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type")
def event_dedup(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    return logs.without_repeats(events, "user_id", "event_id", "event_type").select(F.col("user_id").alias("task_id"), "event_id")


@query(f"{o.TASKS} SELECT task_id, session_id, status, created_at, started_at, finished_at, attempt_count, lease_expires_at FROM tasks")
def task_current(spark, sf_dir):
    made = tasks.current(tables.task_events(spark, sf_dir), SETTINGS)
    return made.select("task_id", "session_id", "status", "created_at", "started_at", "finished_at", "attempt_count", "lease_expires_at")


_NOW = 900_000_000.0


@query(f"{o.TASKS} SELECT task_id, 'running' AS status, CAST({_NOW + 1800} AS DOUBLE) AS lease_expires_at, attempt_count + 1 AS attempt_count FROM tasks WHERE status = 'pending' ORDER BY created_at, task_id LIMIT 25")
def task_claim(spark, sf_dir):
    made = tasks.claim(tasks.current(tables.task_events(spark, sf_dir), SETTINGS), _NOW, SETTINGS, 25)
    return made.select("task_id", "status", "lease_expires_at", "attempt_count")


@query(f"{o.TASKS} SELECT CASE WHEN status = 'running' AND lease_expires_at < {_NOW} THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'running' AND lease_expires_at < {_NOW}) AS recovered FROM tasks GROUP BY 1")
def task_stale(spark, sf_dir):
    made = tasks.recover_stale(tasks.current(tables.task_events(spark, sf_dir), SETTINGS), _NOW)
    return made.groupBy("status").agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"))


@query(f"{o.TASKS} SELECT task_id, created_at FROM tasks WHERE session_id = '1-URGENT' ORDER BY created_at DESC, task_id LIMIT 200")
def task_list(spark, sf_dir):
    return tasks.of_session(tasks.current(tables.task_events(spark, sf_dir), SETTINGS), "1-URGENT").select("task_id", "created_at")


@query(f"{o.TASKS} SELECT session_id, task_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, task_id) AS place FROM tasks QUALIFY place <= 200")
def task_sessions(spark, sf_dir):
    made = tasks.newest_of_sessions(tasks.current(tables.task_events(spark, sf_dir), SETTINGS))
    return made.select("session_id", "task_id", F.col("place").cast("long").alias("place"))


@query(f"{o.TASKS} SELECT task_id, progress, upload_url, report_url FROM tasks")
def task_links(spark, sf_dir):
    made = tasks.with_links(tasks.current(tables.task_events(spark, sf_dir), SETTINGS))
    return made.select("task_id", "progress", "upload_url", "report_url")


@query(
    f"""{o.TASKS}, s AS (SELECT task_id, status FROM tasks WHERE NOT (status = 'running' AND lease_expires_at < {_NOW}) AND status NOT IN ('pending')
  UNION ALL SELECT task_id, CASE WHEN row_number() OVER (ORDER BY created_at, task_id) <= 40 THEN CASE WHEN k % 2 = 0 THEN 'done' ELSE 'failed' END ELSE 'pending' END FROM tasks WHERE status = 'pending' OR (status = 'running' AND lease_expires_at < {_NOW}))
SELECT status, count(*) AS n FROM s GROUP BY status"""
)
def task_transitions(spark, sf_dir):
    """A worker's turn written as events: stale runs put back, forty tasks claimed and worked off, the state derived again."""
    events = tables.task_events(spark, sf_dir)
    before = tasks.recover_stale(tasks.current(events, SETTINGS), _NOW)
    taken = tasks.claim(before, _NOW, SETTINGS, 40)
    even = F.col("task_id").cast("long") % 2 == 0
    done = tasks.finished(taken.filter(even).withColumn("report_path", F.lit("/r.json")), _NOW + 5)
    lost = tasks.failed(taken.filter(~even).withColumn("error", F.lit("no page")), _NOW + 5)
    for more in (tasks.recovered(before, _NOW), tasks.claimed(taken, _NOW), tasks.progressed(taken, _NOW + 1), done, lost):
        events = events.unionByName(more)
    return tasks.current(events, SETTINGS).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id AS page_id, max(event_id % 900) AS section_max_ms, CAST(sum(event_id % 900) AS BIGINT) AS section_sum_ms, count(*) FILTER (event_id % 5 = 0) AS fallback_count, bool_and(event_id % 7 <> 0) AS cache_hit, bool_or(event_id % 35 = 0) AS fallback_cached,
coalesce(string_agg(CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'late ' || event_id END, '; ' ORDER BY event_id) FILTER (event_id % 5 = 0), '') AS error FROM events GROUP BY user_id"""
)
def section_times(spark, sf_dir):
    e = F.col("event_id")
    rows = tables.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), F.col("event_type").alias("section"), e.alias("first_seq"), (e % 900).alias("duration_ms"), (e % 7 != 0).alias("cache_hit"), (e % 5 == 0).alias("fallback"),
        (e % 35 == 0).alias("fallback_cached"), F.when(e % 10 == 0, "").when(e % 5 == 0, F.concat(F.lit("late "), e.cast("string"))).alias("error"),
    )
    return policies.section_times(rows)


_MODEL_ROWS = (
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'aliyun' ELSE 'other' END AS provider, CASE event_id % 3 WHEN 0 THEN 'spare-ocr' WHEN 1 THEN 'big-vl' END AS model, "
    "CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS value, CASE WHEN event_id % 4 = 0 THEN 'late' END AS error, CASE event_id % 6 WHEN 0 THEN '0.4' WHEN 1 THEN '0' WHEN 2 THEN 'high' WHEN 3 THEN NULL ELSE '-1' END AS stated FROM events"
)
_ASKING = Settings(fallback_model="spare-ocr")


@query(
    f"WITH r AS ({_MODEL_ROWS}) SELECT event_id, CASE WHEN coalesce(try_cast(stated AS DOUBLE), 0) <= 0 AND value <> '' AND contains(coalesce(model, ''), 'ocr') THEN CAST(0.72 AS DOUBLE) ELSE coalesce(try_cast(stated AS DOUBLE), CAST(0 AS DOUBLE)) END AS confidence, "
    "CASE WHEN provider = 'aliyun' AND model IS DISTINCT FROM 'spare-ocr' THEN 'spare-ocr' ELSE '' END AS fallback, provider = 'aliyun' AND value = '' AND error IS NOT NULL AND model IS DISTINCT FROM 'spare-ocr' AS again FROM r"
)
def model_policies(spark, sf_dir):
    """How sure an answer is, whom to ask next and whether to."""
    events = tables.table(spark, sf_dir, "events")
    rows = events.selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN 'aliyun' ELSE 'other' END AS provider", "CASE event_id % 3 WHEN 0 THEN 'spare-ocr' WHEN 1 THEN 'big-vl' END AS model", "CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS value",
        "CASE WHEN event_id % 4 = 0 THEN 'late' END AS error", "CASE event_id % 6 WHEN 0 THEN '0.4' WHEN 1 THEN '0' WHEN 2 THEN 'high' WHEN 3 THEN NULL ELSE '-1' END AS stated",
    )
    c = F.col
    return rows.select(
        "event_id",
        policies.confidence(c("stated"), c("model"), c("value"), c("value")).alias("confidence"),
        policies.fallback_model(c("provider"), c("model"), _ASKING).alias("fallback"),
        policies.asks_again(c("provider"), c("model"), c("value"), c("value"), c("error"), _ASKING).alias("again"),
    )


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'x' WHEN 2 THEN event_type ELSE '' END AS value, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'X' WHEN 2 THEN event_type ELSE '' END AS normalized_value, "
    "CASE event_id % 4 WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, CASE WHEN event_id % 4 = 3 THEN 'unreadable answer' END AS error FROM events"
)
def model_answers(spark, sf_dir):
    """Answers with fences, with words around them, without JSON and with broken JSON, read."""
    e = F.col("event_id") % 4
    answer = (
        F.when(e == 0, F.concat(F.lit('```json\n{"value": "'), F.col("event_type"), F.lit('", "confidence": 0.5}\n```')))
        .when(e == 1, 'so: {"value": " x ", "normalized_value": "X", "confidence": "0.9"} bye')
        .when(e == 2, F.col("event_type"))
        .otherwise("{broken}")
    )
    rows = tables.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"), F.lit("m-vl").alias("model"))
    return policies.readings(rows).select("event_id", "value", "normalized_value", "confidence", "error")


@query(
    """SELECT event_id, '/runs/r/' || CASE WHEN event_id % 3 = 0 THEN 'ppocr_rois/' WHEN event_id % 3 = 1 THEN 'rois/' ELSE '' END || event_id || '.png' AS url,
event_id % 2 = 0 OR event_id % 5 = 0 AS skipped FROM events"""
)
def evidence_links(spark, sf_dir):
    """Addresses of evidence images, and which pages' issues are ranked by rule alone."""
    e = F.col("event_id")
    path = F.concat(F.when(e % 3 == 0, "/o/r/ppocr_rois/").when(e % 3 == 1, "/o/r/rois/").otherwise("/o/r/"), e.cast("string"), F.lit(".png"))
    skipped = policies.skips_triage(F.when(e % 2 == 0, "late").otherwise(""), F.when(e % 5 == 0, F.array(F.lit("oil"))), SETTINGS)
    return tables.table(spark, sf_dir, "events").select("event_id", policies.evidence_url(F.lit("r"), path).alias("url"), skipped.alias("skipped"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS line_no, event_type AS event, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, '[redacted]' AS token, NULL AS empty FROM events"""
)
def log_lines(spark, sf_dir):
    """Log rows as the lines that are written, read back."""
    payload = F.create_map(F.lit("n"), F.col("line_no").cast("string"), F.lit("my_Token"), F.col("event"), F.lit("empty"), F.lit(""))
    made = logs.lines(tables.logs(spark, sf_dir).withColumn("payload", payload))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return made.select("day", get("n").cast("long").alias("line_no"), get("event").alias("event"), get("level").alias("level"), get("my_Token").alias("token"), get("empty").cast("int").alias("empty"))


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", caches.content_key(F.col("text")).alias("key"))
    at = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("doc_id").cast("double"))
    return docs, docs.filter("doc_id % 2 = 0").withColumn("cached_at", at)


_CACHE = "WITH r AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT key, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS cached_at FROM r WHERE doc_id % 2 = 0)"


@query(f"{_CACHE} SELECT doc_id FROM r WHERE key IN (SELECT key FROM c)")
def cache_hits(spark, sf_dir):
    requests, cache = _requests(spark, sf_dir)
    return caches.hits(requests, cache).select("doc_id")


@query(f"{_CACHE} SELECT doc_id FROM r WHERE key NOT IN (SELECT key FROM c)")
def cache_misses(spark, sf_dir):
    requests, cache = _requests(spark, sf_dir)
    return caches.misses(requests, cache).select("doc_id")


@query(f"{_CACHE} SELECT doc_id FROM r WHERE key IN (SELECT key FROM c WHERE cached_at IS NULL OR 2000 - cached_at <= 1800)")
def cache_ttl(spark, sf_dir):
    requests, cache = _requests(spark, sf_dir)
    return caches.hits(requests, caches.live(cache, 2000.0, SETTINGS)).select("doc_id")


@query(
    f"""{_CACHE}, e AS (SELECT key, CASE WHEN doc_id % 3 = 0 THEN 5000 END AS since, doc_id FROM r WHERE doc_id % 3 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0))
SELECT key, CAST(doc_id AS VARCHAR) AS answer, CAST(since AS DOUBLE) AS cached_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY since NULLS FIRST, CAST(doc_id AS VARCHAR)) AS n FROM e) WHERE n = 1"""
)
def cache_entries(spark, sf_dir):
    """What is saved of results: good readings, timeouts with their time, no errors, nothing empty."""
    docs, k = _requests(spark, sf_dir)[0], F.col("doc_id")
    results = docs.select(
        "key", k.cast("string").alias("answer"), F.when(k % 7 == 0, "").otherwise("v").alias("value"), F.lit(None).cast("string").alias("normalized_value"), F.when(k % 5 == 0, "bad").alias("error"), (k % 3 == 0).alias("timed_out"),
    )
    return caches.entries(results, 5000.0, SETTINGS)


@query(f"WITH {o.BLOCKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_seq) - 1 AS block_seq, 'b' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY block_seq) - 1 AS VARCHAR), 4, '0') AS block_id, text, score, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM blocks WHERE block_seq % 11 <> 0 AND text <> ''")
def nested_extract(spark, sf_dir):
    made = ocr.blocks(tables.recogniser_results(spark, sf_dir))
    return made.select("page_id", F.col("block_seq").cast("long").alias("block_seq"), "block_id", "text", "score", "cx", "cy")


@query(f"WITH {o.BLOCKS} SELECT page_id, block_seq, text, score, (x1 + x2) / 2 AS cx FROM blocks")
def block_round_trip(spark, sf_dir):
    blocks = tables.form_blocks(spark, sf_dir).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "source": F.lit("derived")})
    return ocr.blocks_from_json(ocr.block_json(blocks)).select("page_id", "block_seq", "text", "score", "cx")


@query(
    f"""WITH {o.BLOCKS}, n AS (SELECT page_id, count(*) FILTER (block_seq % 11 <> 0 AND text <> '') AS n FROM blocks GROUP BY page_id),
p AS (SELECT *, page_id % 5 = 0 AND page_id % 10 <> 0 AS hit, page_id % 7 AS k FROM n),
e AS (SELECT *, CASE WHEN hit THEN NULL WHEN k = 2 THEN 'no job' WHEN k = 3 THEN 'unreadable job.json' WHEN k = 0 THEN 'too dark' WHEN k = 1 THEN 'expired' WHEN k = 4 THEN 'ppocr_job_failed'
  WHEN page_id % 11 = 0 THEN 'no result.jsonl' WHEN page_id % 13 = 0 THEN 'unreadable lines in result.jsonl: 2' END AS error FROM p)
SELECT page_id, hit OR error IS NULL AS ok, error, CASE WHEN hit THEN 'cache' WHEN k IN (5, 6) THEN 'j' || page_id END AS job_id, hit AS cache_hit, CAST(CASE WHEN hit THEN 2 WHEN error IS NULL THEN n ELSE 0 END AS INTEGER) AS n_blocks FROM e"""
)
def ingest_jobs(spark, sf_dir):
    """What became of each page's recogniser job, of those that the cache lacks: failed, unreadable, missing, broken and fine ones."""
    results, k = tables.recogniser_results(spark, sf_dir), F.col("page_id") % 7
    pages = results.select("page_id", caches.content_key(F.col("page_id").cast("string")).alias("key"))
    job = (
        F.when(k == 0, '{"ok": false, "state": "failed", "error": "too dark"}').when(k == 1, '{"ok": false, "state": "expired", "error": ""}').when(k == 3, '{"ok": tr')
        .when(k == 4, '{"state": null}').otherwise(F.concat(F.lit('{"ok": true, "job_id": "j'), F.col("page_id").cast("string"), F.lit('", "pages": [1]}')))
    )
    made = results.filter(k != 2).select("page_id", job.alias("value"), (F.col("page_id") % 11 != 0).alias("has_result"))
    noise = F.when(F.col("page_id") % 13 == 0, F.array(F.lit('{"result": {'), F.lit(" "), F.lit("null and void"))).otherwise(F.array(F.lit(""), F.lit("{}")))
    lines = results.select("page_id", F.posexplode(F.concat(F.array(F.to_json(F.struct("result"))), noise)).alias("line_no", "value"))
    known = F.when(F.col("page_id") % 10 == 0, '[{"id": "b0000"}').otherwise('[{"id": "b0000", "text": "x", "box": [1, 2, 3, 4]}, {"id": "b0001", "text": "y"}]')
    cache = pages.filter("page_id % 5 = 0").select("key", known.alias("answer"), F.lit(None).cast("double").alias("cached_at"))
    rows = jobs.ingested(pages, made, lines, cache, 0.0, SETTINGS)[0]
    return rows.select("page_id", "ok", "error", "job_id", "cache_hit", F.size("blocks").alias("n_blocks"))


@query(
    r"""WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || '{"summary": "s' || event_id || '", "field_candidates": {"a": {"value": "' || event_type || '", "near": [{"b": 1}]}, "b": ' || event_id || '}, "blocks": [1, [2], {}]}' || chr(10) || '```'
  WHEN 1 THEN 'It says {"field_candidates": {"a": {"score": 1}, "b": true}, "blocks": {"x": {"y": 1}}} so far' WHEN 2 THEN event_type || ' only' WHEN 3 THEN '{"field_candidates": ["a"], "summary": "s"}' END AS content FROM events),
j AS (SELECT *, try_cast(nullif(regexp_extract(content, '(?s)[{].*[}]'), '') AS JSON) AS j FROM a),
f AS (SELECT *, coalesce(json_type(j, '$.field_candidates') = 'OBJECT', FALSE) AS found FROM j)
SELECT event_id, CASE WHEN found THEN j->>'$.summary' END AS summary, CAST(CASE WHEN found THEN CASE json_type(j, '$.blocks') WHEN 'ARRAY' THEN json_array_length(j, '$.blocks') ELSE len(json_keys(j, '$.blocks')) END END AS INTEGER) AS block_count,
  CASE WHEN found THEN j->>'$.field_candidates.a.value' END AS a, CASE WHEN found THEN j->>'$.field_candidates.b' END AS b, CASE WHEN NOT found THEN coalesce(content, 'raw ' || event_id) END AS raw_preview FROM f"""
)
def layout_summary(spark, sf_dir):
    """What a layout model says of pages, summed up: fenced, among words, without JSON, with no object of fields, nothing at all."""
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    full = ['```json\n{"summary": "s', n, '", "field_candidates": {"a": {"value": "', F.col("event_type"), '", "near": [{"b": 1}]}, "b": ', n, '}, "blocks": [1, [2], {}]}\n```']
    content = (
        F.when(k == 0, F.concat(*[F.lit(c) if isinstance(c, str) else c for c in full]))
        .when(k == 1, 'It says {"field_candidates": {"a": {"score": 1}, "b": true}, "blocks": {"x": {"y": 1}}} so far')
        .when(k == 2, F.concat("event_type", F.lit(" only")))
        .when(k == 3, '{"field_candidates": ["a"], "summary": "s"}')
    )
    rows = tables.table(spark, sf_dir, "events").select("event_id", content.alias("content"), F.concat(F.lit("raw "), n).alias("raw"))
    made = layout.summaries(rows)
    return made.select("event_id", "summary", "block_count", *[F.col("field_candidates")[c].alias(c) for c in "ab"], "raw_preview")


@query(
    """WITH h AS (SELECT c_custkey AS page_id, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer), p AS (SELECT page_id, list_transform(range(32), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)) AS p FROM h)
SELECT page_id, array_to_string(list_transform(range(8), lambda k: printf('%02X', CAST(round_even((p[16 * (k // 4) + 2 * (k % 4) + 1] + p[16 * (k // 4) + 2 * (k % 4) + 2] + p[16 * (k // 4) + 2 * (k % 4) + 9] + p[16 * (k // 4) + 2 * (k % 4) + 10]) / 4, 0) AS INTEGER))), '') AS pixels FROM p"""
)
def smaller_images(spark, sf_dir):
    """Images of eight by four grey pixels, by hash, at half their size."""
    data = F.unhex(F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256))
    rows = spread(tables.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("page_id"), F.lit(4).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return scans.smaller(rows, 4).select("page_id", F.hex("data").alias("pixels"))
