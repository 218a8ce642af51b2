"""DuckDB SQL for the core queries, put together from the same catalogue and constants; written apart from the Spark plans."""

from __future__ import annotations

from inkgrid.functions import text as t
from inkgrid.operators import profile, rules, triage
from inkgrid.sources.catalog import OIL_QUANTITIES, OIL_ROW, SAMPLE

TODAY = "2024-01-02"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"translate(trim(coalesce({x}, '')), '：／', ':/')"


def compact(x: str) -> str:
    return rf"regexp_replace({norm(x)}, '\s+', '', 'g')"


def na(x: str) -> str:
    return rf"(CASE WHEN regexp_replace(upper({norm(x)}), '[\s/\-]+', '', 'g') = 'NA' THEN 'N/A' ELSE {norm(x)} END)"


def exact(x: str) -> str:
    return f"(CASE WHEN {na(x)} = 'N/A' THEN 'N/A' WHEN lower({compact(x)}) IN ({', '.join(q(s) for s in t.STATION_SPELLINGS)}) THEN '重庆' ELSE {norm(x)} END)"


def comparable(x: str) -> str:
    return rf"lower(regexp_replace({exact(x)}, '\s+', '', 'g'))"


def full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, '{pattern}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def six(x: str) -> str:
    return f"coalesce(list_last(list_filter(regexp_extract_all({x}, '[0-9]+'), lambda d: length(d) = 6)), '')"


def date(x: str) -> str:
    s = f"translate({norm(x)}, './', '--')"
    month, day = "(1[0-2]|0[1-9]|[1-9])", "(3[01]|[12][0-9]|0[1-9]|[1-9])"

    def made(pattern: str, century: str = "") -> str:
        parts = [f"regexp_extract({s}, '{pattern}', {k})" for k in (1, 2, 3)]
        return f"CAST(try_cast(CASE WHEN {parts[0]} <> '' THEN '{century}' || {parts[0]} || '-' || lpad({parts[1]}, 2, '0') || '-' || lpad({parts[2]}, 2, '0') END AS DATE) AS VARCHAR)"

    loose = "(20[0-9]{2})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})"
    p = [f"regexp_extract({s}, '{loose}', {k})" for k in (1, 2, 3)]
    inside = f"CASE WHEN {p[0]} <> '' THEN {p[0]} || '-' || lpad({p[1]}, 2, '0') || '-' || lpad({p[2]}, 2, '0') END"
    return f"coalesce({made(f'^([0-9]{{4}})-{month}-{day}$')}, {made(f'^([0-9]{{2}})-{month}-{day}$', '20')}, {made(f'^([0-9]{{4}}){month}{day}$')}, {inside}, {s})"


def label(x: str) -> str:
    words = "|".join(w.replace(".", "[.]") for w in t.LABEL_WORDS)
    return has(f"upper({x})", f"{words}|(^|[^A-Z])({'|'.join(t.LABEL_WHOLE_WORDS)})([^A-Z]|$)")


def english(x: str) -> str:
    words = rf"list_transform(string_split_regex(trim({x}), '\s+'), lambda w: trim(regexp_replace(regexp_replace(w, '[\x{{4e00}}-\x{{9fff}}]+|[\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]+', ' ', 'g'), '\s+', ' ', 'g')))"
    return f"coalesce(array_to_string(list_filter({words}, lambda w: regexp_matches(w, '[A-Za-z]') AND upper(w) NOT IN ({', '.join(q(w) for w in t.DROPPED_WORDS)})), ' '), '')"


def body(x: str) -> str:
    c = f"upper({compact(x)})"
    return (
        rf"(trim({x}) <> '' AND NOT {label(f'trim({x})')} AND NOT {full(c, t.DATE_INSIDE)} AND {c} NOT IN ('N/A', 'NA', 'MA', 'M/A') AND trim({x}) NOT IN ('渝', '重庆') AND NOT {full(c, t.NUMBER)} "
        rf"AND NOT {full(c, r'[A-Z]{2,}[0-9][\w./-]*')} AND (len(regexp_extract_all({x}, '[\x{{4e00}}-\x{{9fff}}]')) >= 4 OR len(regexp_extract_all({x}, '[A-Za-z]')) >= 12))"
    )


BLOCKS = """blocks AS (
  SELECT user_id AS page_id, event_id AS block_seq, 'b' || event_id AS block_id,
    CASE event_id % 16 WHEN 0 THEN CAST(event_id % 30 AS VARCHAR) WHEN 1 THEN 'N/A' WHEN 2 THEN '重庆' WHEN 3 THEN 'AMM' || event_id
      WHEN 4 THEN 'CAACML' || lpad(CAST(event_id AS VARCHAR), 8, '0') WHEN 5 THEN strftime(ts, '%Y.%m.%d') WHEN 6 THEN event_type
      WHEN 7 THEN 'replaced oil pump 更换油泵并试车' WHEN 8 THEN CASE WHEN event_id % 3 = 0 THEN 'checked' ELSE '勾选' END WHEN 9 THEN ''
      WHEN 10 THEN 'pump seal leaking at station ' || event_id WHEN 11 THEN '更换前轮胎并完成测试' WHEN 12 THEN CASE WHEN event_id % 3 = 0 THEN 'SIGN DATE' ELSE '报告者' END
      WHEN 13 THEN '2024.01.02' WHEN 14 THEN CASE WHEN event_id % 3 = 0 THEN '李冬' ELSE 'A. Meyer' END
      ELSE lpad(CAST(event_id AS VARCHAR), 6, '0') END AS text,
    CAST(event_id % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS score,
    CAST((event_id * 37) % 2200 AS DOUBLE) AS x1, CAST((event_id * 53) % 1600 AS DOUBLE) AS y1,
    CAST((event_id * 37) % 2200 + 20 + event_id % 90 AS DOUBLE) AS x2, CAST((event_id * 53) % 1600 + 18 + event_id % 40 AS DOUBLE) AS y2
  FROM events)"""

EXTENT = """extent AS (SELECT page_id, greatest(max(x2) * CAST(1.04 AS DOUBLE), CAST(1 AS DOUBLE)) AS page_w, greatest(max(y2) * CAST(1.04 AS DOUBLE), CAST(1 AS DOUBLE)) AS page_h FROM blocks GROUP BY page_id)"""


def _plain(value: str) -> str:
    """The comparable form of a catalogue value, which has no blanks: N/A and station spellings, lower-cased."""
    low = value.lower()
    return "n/a" if low in ("na", "n/a") else "重庆" if low in t.STATION_SPELLINGS else low


def fields() -> str:
    rows = []
    for k, f in enumerate(SAMPLE):
        p, a = f["params"], f["assignment"]
        lengths = p.get("allow_lengths", [])
        digits = max(lengths) if f["validator"] == "digit_length" and lengths else len(str(int(p.get("max", 999999)) - 1)) if f["validator"] == "number_less_than" else 6
        enough = min(lengths) if f["validator"] == "digit_length" and lengths else 4
        rows.append(
            (k, f["id"], f["label"], f["section"], f["recognizer"], f["validator"], f["fail_msg"], *a["search_bbox"], p.get("min"), p.get("max"), [_plain(x) for x in p.get("allow", [])] or None,
             [_plain(x) for x in p.get("not_allow", ("重庆", "渝", "chongqing"))], [x.upper() for x in p.get("prefixes", [])] or None, [_plain(x).upper() for x in p.get("allow_exact", [])] or None,
             p.get("pattern"), lengths or None, digits, enough, p.get("min_letters", 1), p.get("min_cjk", 1), a.get("value_type"), a.get("row"),
             *(bool(a.get(n)) for n in ("needs_review", "roi_review", "roi_review_always", "prefer_roi_vlm")))
        )
    names = (
        "field_seq, field_id, label, section, recognizer, validator, fail_msg, tx, ty, tw, th, pmin, pmax, allowed, forbidden, prefixes, allowed_exact, pattern, lengths, max_digits, enough, "
        "min_letters, min_cjk, kind, row_, f_review, roi_review, roi_always, prefer_roi"
    )
    values = ",\n  ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"fields AS (SELECT * FROM (VALUES\n  {values}) v({names}))"


FACTS = f"""facts AS (
  SELECT b.*, page_w, page_h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {compact('text')} AS compact, upper({compact('text')}) AS up, {comparable('text')} AS cmp,
    {full(compact('text'), t.NUMBER)} AS f_number, {full(compact('text'), t.DATE_INSIDE + '|20[0-9]{6}')} AS f_date, {label('text')} AS f_label, {exact('text')} = '重庆' AS f_station,
    {has('text', t.DATE_INSIDE)} AS f_date_inside, {has('text', '[A-Za-z]')} AS f_latin, {has('text', '[一-鿿]')} AS f_cjk, {six('text')} <> '' AS f_auth
  FROM blocks b JOIN extent USING (page_id))"""

VETO = """CASE WHEN kind = 'signature' THEN (f_label AND recognizer <> 'checkbox') OR f_station OR f_date OR f_number
    WHEN kind = 'authorization' THEN NOT f_auth WHEN kind = 'license' THEN NOT regexp_matches(up, 'CA|[0-9]{4,8}') WHEN kind = 'text' THEN f_station OR f_date
    WHEN validator IN ('int_range', 'digit_length', 'number_less_than') THEN NOT f_number WHEN validator = 'same_day' THEN NOT f_date_inside
    WHEN validator = 'regex' THEN NOT coalesce(regexp_full_match(up, pattern), FALSE) AND NOT regexp_matches(up, 'CAAC|AUTH|授权|[0-9]{6}')
    WHEN validator = 'exact_text' THEN coalesce(NOT list_contains(allowed, cmp), FALSE) ELSE FALSE END"""

PATTERN = f"""CAST(CASE WHEN recognizer = 'checkbox' THEN 0
    WHEN validator = 'regex' AND regexp_full_match(up, pattern) THEN 1 WHEN validator = 'regex' AND regexp_matches(up, 'CAAC|[0-9]{{6}}') THEN 0.65
    WHEN validator = 'prefix_or_exact' AND (list_contains(allowed_exact, upper(cmp)) OR len(list_filter(prefixes, lambda p: starts_with(up, p))) > 0) THEN 1
    WHEN validator = 'prefix_or_exact' AND regexp_matches(up, 'AMM|TSM|FLA') THEN 0.85 WHEN validator = 'prefix_or_exact' AND regexp_matches(up, '[A-Z]{{2,}}[0-9]') THEN 0.35
    WHEN validator = 'same_day' THEN CASE WHEN f_date_inside THEN 1 ELSE 0 END
    WHEN validator = 'int_range' THEN CASE WHEN try_cast(compact AS DOUBLE) BETWEEN pmin AND pmax THEN 1 WHEN try_cast(compact AS DOUBLE) IS NOT NULL THEN 0.08 ELSE 0 END
    WHEN validator IN ('digit_length', 'number_less_than') THEN CASE WHEN f_number THEN 0.9 ELSE 0 END
    WHEN validator IN ('bilingual_text', 'contains_english') AND f_label THEN 0
    WHEN validator = 'bilingual_text' THEN CASE WHEN f_latin AND f_cjk THEN 0.9 WHEN f_latin OR f_cjk THEN 0.45 ELSE 0 END
    WHEN validator = 'contains_english' THEN CASE WHEN f_latin THEN 0.8 ELSE 0 END
    WHEN validator = 'english_text' THEN CASE WHEN f_latin AND NOT f_cjk THEN 0.8 WHEN f_latin THEN 0.35 ELSE 0 END
    WHEN validator = 'exact_text' AND list_contains(allowed, cmp) THEN 1
    WHEN validator = 'name_not_place' THEN CASE WHEN compact <> '' AND NOT f_station THEN 0.6 ELSE 0 END
    WHEN kind = 'signature' THEN CASE WHEN {VETO} THEN 0 ELSE 0.55 END
    WHEN kind = 'authorization' THEN CASE WHEN f_auth THEN 0.8 ELSE 0 END
    WHEN kind = 'license' AND starts_with(up, 'CAAC') THEN 0.8 WHEN kind = 'license' AND (starts_with(up, 'CA') OR regexp_full_match(up, '[0-9]{{4,8}}')) THEN 0.45 ELSE 0 END AS DOUBLE)"""

PAIRS = f"""geo AS (
  SELECT *, tx * sx AS bx1, ty * sy AS by1, (tx + tw) * sx AS bx2, (ty + th) * sy AS by2
  FROM (SELECT *, page_w / CAST(2400 AS DOUBLE) AS sx, page_h / CAST(1784 AS DOUBLE) AS sy FROM facts CROSS JOIN fields)),
sized AS (SELECT *, least(x2, bx2) - greatest(x1, bx1) AS iw, least(y2, by2) - greatest(y1, by1) AS ih, bx2 - bx1 AS bw, by2 - by1 AS bh FROM geo),
pairs AS (
  SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / greatest((x2 - x1) * (y2 - y1), 1) ELSE CAST(0 AS DOUBLE) END AS overlap,
    cx BETWEEN bx1 - bw * CAST(0.18 AS DOUBLE) AND bx2 + bw * CAST(0.18 AS DOUBLE) AND cy BETWEEN by1 - bh * CAST(0.18 AS DOUBLE) AND by2 + bh * CAST(0.18 AS DOUBLE) AS near,
    greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - sqrt((cx - (bx1 + bx2) / 2) * (cx - (bx1 + bx2) / 2) + (cy - (by1 + by2) / 2) * (cy - (by1 + by2) / 2)) / (sqrt(bw * bw + bh * bh) * CAST(1.35 AS DOUBLE))) AS distance,
    {PATTERN} AS pattern_score
  FROM sized),
kept AS (SELECT * FROM pairs WHERE (overlap > 0 OR near) AND NOT (f_label AND recognizer <> 'checkbox') AND NOT ({VETO}))"""

SCORED = """scored AS (
  SELECT *, (score * CAST(0.45 AS DOUBLE) + overlap * CAST(1.5 AS DOUBLE) + distance * CAST(0.45 AS DOUBLE) + pattern_score * CAST(0.7 AS DOUBLE)
      + CASE WHEN kind IS NOT NULL AND pattern_score > 0 THEN CAST(0.25 AS DOUBLE) ELSE 0 END
      + CASE WHEN row_ = 'last' THEN greatest(CAST(0 AS DOUBLE), least((cy - by1) / greatest(bh, 1), CAST(1 AS DOUBLE))) * CAST(0.55 AS DOUBLE) ELSE 0 END)
      * CASE WHEN validator = 'int_range' AND pattern_score < CAST(0.2 AS DOUBLE) THEN CAST(0.45 AS DOUBLE) ELSE 1 END AS cand_score
  FROM kept),
top8 AS (SELECT *, row_number() OVER (PARTITION BY page_id, field_id ORDER BY cand_score DESC, block_seq) AS rank FROM scored WHERE cand_score > 0 QUALIFY rank <= 8)"""


def _round(n: int) -> str:
    return f"""r{n}a AS (SELECT *, row_number() OVER (PARTITION BY page_id, field_id ORDER BY rank) AS r FROM {'top8' if n == 1 else f'r{n - 1}'}),
lost{n} AS (SELECT page_id, field_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY cand_score DESC, field_seq) AS c FROM r{n}a WHERE r = 1 AND validator NOT IN ('bilingual_text', 'english_text')) WHERE c > 1),
r{n} AS (SELECT * EXCLUDE (r) FROM r{n}a ANTI JOIN lost{n} USING (page_id, field_id, block_id))"""


RESOLVED = ",\n".join(_round(n) for n in (1, 2, 3)) + ",\nresolved AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY page_id, field_id ORDER BY rank) AS rank FROM r3)"

MATCHED = ",\n".join([BLOCKS, EXTENT, fields(), FACTS, PAIRS, SCORED])


def repaired(x: str, field: str = "field_id", low: str = "pmin", high: str = "pmax") -> str:
    c = compact(x)
    return f"(CASE WHEN {field} IN ({', '.join(q(f) for f in OIL_QUANTITIES)}) AND {full(c, '7[0-9]([.][0-9]+)?')} AND try_cast('2' || substr({c}, 2) AS DOUBLE) BETWEEN {low} AND {high} THEN '2' || substr({c}, 2) ELSE {norm(x)} END)"


def for_pattern(x: str, pattern: str = "pattern") -> str:
    bare = f"upper(replace({norm(x)}, ' ', ''))"
    return (
        f"(CASE WHEN {pattern} = {q(t.AUTHORIZATION_PATTERN)} AND {six(norm(x))} <> '' THEN {six(norm(x))} WHEN {pattern} = {q(t.LICENSE_PATTERN)} AND {has(bare, 'CAACML[0-9]{8}')} THEN regexp_extract({bare}, 'CAACML[0-9]{{8}}') "
        f"WHEN {pattern} = {q(t.LICENSE_PATTERN)} AND {has(bare, 'CAAC[A-Z]*[0-9]{8}')} THEN regexp_extract({bare}, 'CAAC[A-Z]*[0-9]{{8}}') ELSE {bare} END)"
    )


def number(x: str) -> str:
    return f"try_cast(regexp_extract({x}, '{rules.SIGNED_NUMBER}', 1) AS DOUBLE)"


def _noise(x: str) -> str:
    names = ", ".join(q(w.lower()) for w in t.NAME_NOISE)
    return f"{comparable(x)} IN ({names}) OR upper({compact(x)}) IN ({', '.join(q(w) for w in t.NAME_NOISE)}) OR {has(f'upper({norm(x)})', '|'.join(t.NAME_NOISE_PARTS))}"


def rule_sql(v: str) -> dict[str, str]:
    """Each rule over the value v and the columns of `fields`."""
    cjk = r"[\x{4e00}-\x{9fff}]"
    return {
        "int_range": f"{number(repaired(v))} BETWEEN pmin AND pmax",
        "exact_text": f"list_contains(allowed, {comparable(v)})",
        "checked": f"lower({v}) IN ({', '.join(q(w) for w in t.CHECKED_WORDS)})",
        "english_text": f"{has(v, '[A-Za-z]')} AND NOT {has(v, cjk)}",
        "contains_english": has(v, "[A-Za-z]"),
        "bilingual_text": f"len(regexp_extract_all({v}, '[A-Za-z]')) >= greatest(min_letters, 1) AND len(regexp_extract_all({v}, '{cjk}')) >= greatest(min_cjk, 1)",
        "name_not_place": f"{comparable(v)} <> '' AND NOT list_contains(forbidden, {comparable(v)}) AND {na(v)} <> 'N/A' AND NOT {full(compact(v), t.DATE_INSIDE + '|20[0-9]{6}|' + t.NUMBER)} AND NOT ({_noise(v)}) AND {has(v, cjk + '|[A-Za-z]')}",
        "prefix_or_exact": f"list_contains(allowed_exact, upper({comparable(v)})) OR len(list_filter(prefixes, lambda p: starts_with(upper({compact(v)}), p))) > 0",
        "regex": f"regexp_full_match({for_pattern(v)}, pattern)",
        "same_day": f"{date(v)} = '{TODAY}'",
        "digit_length": f"list_contains(lengths, length(regexp_replace({v}, '[^0-9]', '', 'g')))",
        "number_less_than": f"{number(v)} < pmax",
        "present": f"{v} <> ''",
        "optional": "TRUE",
    }


def passed(v: str) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN validator = {q(n)} THEN {s}" for n, s in rule_sql(v).items()) + " ELSE FALSE END, FALSE)"


def normal(v: str) -> str:
    """A value in the form its rule compares."""
    return (
        f"(CASE WHEN validator IN ('english_text', 'contains_english') THEN {english(v)} WHEN validator = 'exact_text' THEN {exact(v)} "
        f"WHEN validator = 'prefix_or_exact' THEN CASE WHEN {na(v)} = 'N/A' THEN 'N/A' ELSE upper({compact(v)}) END "
        f"WHEN validator = 'int_range' THEN {repaired(v)} WHEN validator = 'regex' THEN {for_pattern(v)} WHEN validator = 'same_day' THEN {date(v)} "
        f"WHEN validator IN ('digit_length', 'number_less_than') THEN regexp_replace({v}, '[^0-9]', '', 'g') ELSE trim({v}) END)"
    )


def _digits(x: str) -> str:
    return f"(CASE WHEN {full(compact(x), '[0-9]+')} THEN {compact(x)} ELSE '' END)"


def merged() -> str:
    """The first candidate's digits, lengthened by fragments to its right, as a fold."""
    start, tall, two = _digits("cs[1].text"), "greatest(cs[1].y2 - cs[1].y1, CAST(1 AS DOUBLE))", "CAST(2.2 AS DOUBLE)"
    fits = (
        f"{_digits('c.text')} <> '' AND c.x1 >= cs[1].x2 - {tall} * CAST(0.2 AS DOUBLE) AND abs(c.cy - cs[1].cy) <= greatest({tall}, c.y2 - c.y1, CAST(1 AS DOUBLE)) * CAST(0.75 AS DOUBLE) "
        "AND c.score >= cs[1].score * CAST(0.25 AS DOUBLE)"
    )
    entry = f"{{'x1': c.x1, 'rank': c.rank, 'x2': c.x2, 'd': {_digits('c.text')}}}"
    fragments = f"list_sort(list_transform(list_filter(cs[2:8], lambda c: {fits}), lambda c: {entry}))"
    first = f"{{'x1': cs[1].x1, 'rank': cs[1].rank, 'x2': cs[1].x2, 'd': {start}}}"
    joined = (
        f"CASE WHEN length(s.d) + length(c.d) <= max_digits AND c.x1 - s.x2 <= greatest({tall} * {two}, CAST(55 AS DOUBLE)) "
        "THEN {'x1': s.x1, 'rank': s.rank, 'x2': greatest(s.x2, c.x2), 'd': s.d || c.d} ELSE s END"
    )
    return f"(CASE WHEN {start} = '' OR length({start}) >= least(max_digits, enough) THEN {start} ELSE list_reduce(list_prepend({first}, {fragments}), lambda s, c: {joined}).d END)"


CLEANED = f"""cands AS (SELECT page_id, field_id, list({{'text': text, 'score': cand_score, 'rank': rank, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cy': cy}} ORDER BY rank) AS cs FROM resolved GROUP BY page_id, field_id),
base AS (SELECT p.page_id, f.*, coalesce(cs, []) AS cs FROM (SELECT DISTINCT page_id FROM blocks) p CROSS JOIN fields f LEFT JOIN cands c ON c.page_id = p.page_id AND c.field_id = f.field_id),
best AS (
  SELECT *, CASE WHEN len(cs) = 0 THEN '' WHEN validator IN ('digit_length', 'number_less_than') THEN coalesce(nullif({merged()}, ''), cs[1].text)
      WHEN validator IN ('english_text', 'contains_english') THEN coalesce(array_to_string(list_filter(list_transform(cs[1:6], lambda c: {english('c.text')}), lambda x: x <> ''), ' '), '')
      WHEN validator = 'bilingual_text' OR (validator = 'present' AND kind = 'free_text') THEN coalesce(array_to_string(list_transform(list_filter(cs[1:8], lambda c: {body('c.text')}), lambda c: trim(c.text)), ' '), '')
      ELSE cs[1].text END AS value,
    CASE WHEN len(cs) > 0 THEN least(cs[1].score / 3, CAST(0.95 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS confidence FROM base),
cleaned AS (
  SELECT *, {normal('value')} AS normalized_value,
    f_review OR len(cs) = 0 OR confidence < CAST(0.45 AS DOUBLE) AS needs0,
    list_filter(cs[1:4], lambda c: {full(compact('c.text'), t.NUMBER)}) AS nums FROM best),
doubted AS (
  SELECT *, CASE WHEN validator IN ('digit_length', 'int_range', 'number_less_than') AND section IN ('oil', 'apu') AND len(nums) >= 2 AND nums[1].text <> nums[2].text
      AND nums[2].score / greatest(nums[1].score, CAST(0.001 AS DOUBLE)) >= CAST(0.68 AS DOUBLE) THEN '存在相近数字候选，等待ROI复核' ELSE '' END AS doubt FROM cleaned),
checks0 AS (
  SELECT *, needs0 OR doubt <> '' AS needs_review, CASE WHEN needs0 THEN '需人工复核' ELSE doubt END AS review_reason,
    {norm("coalesce(nullif(normalized_value, ''), value, '')")} AS v FROM doubted),
checks AS (SELECT *, {passed('v')} AS passed FROM checks0),
messaged AS (SELECT *, CASE WHEN passed THEN '' ELSE fail_msg END AS message FROM checks)"""

PLANNED = f"""eligible AS (
  SELECT *, CASE WHEN recognizer = 'checkbox' THEN FALSE WHEN roi_always THEN TRUE WHEN needs_review AND validator IN ('digit_length', 'int_range', 'number_less_than') THEN TRUE WHEN passed THEN FALSE
      WHEN prefer_roi OR roi_review THEN TRUE WHEN validator IN ('digit_length', 'int_range', 'number_less_than', 'regex') THEN TRUE
      WHEN v = '' AND validator IN ('exact_text', 'same_day', 'name_not_place', 'present') THEN TRUE ELSE FALSE END AS eligible,
    CASE WHEN passed THEN 0 ELSE 100 END + CASE WHEN regexp_matches(label, '授权号|执照号|APU|滑油|签名') THEN 80 ELSE 0 END
      + CASE WHEN validator IN ('regex', 'digit_length', 'int_range', 'number_less_than') THEN 30 WHEN validator = 'same_day' THEN 15 ELSE 0 END
      + CASE WHEN needs_review THEN 40 ELSE 0 END + CASE WHEN coalesce(nullif(normalized_value, ''), value) = '' THEN 20 ELSE 0 END AS priority
  FROM messaged),
turns AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY page_id, eligible ORDER BY priority DESC, field_seq) END AS review_turn FROM eligible),
planned AS (SELECT *, coalesce(eligible AND review_turn <= 6, FALSE) AS selected FROM turns)"""

RISK = f"""risked AS (
  SELECT *, CASE WHEN validator IN ('regex', 'digit_length', 'same_day', 'number_less_than') THEN 80 WHEN validator = 'int_range' THEN 70 WHEN validator IN ('exact_text', 'name_not_place') THEN 45 ELSE 0 END
      + CASE WHEN contains(label, '签') OR recognizer = 'signature_or_text' THEN 60 ELSE 0 END + CASE WHEN regexp_matches(label, '{triage.RISKY_LABEL}') THEN 35 ELSE 0 END
      + CASE WHEN needs_review THEN 12 ELSE 0 END + CASE WHEN eligible AND NOT selected THEN 18 ELSE 0 END AS risk FROM planned),
issues AS (
  SELECT *, CASE WHEN NOT passed THEN 0 WHEN needs_review THEN 1 END AS ikind,
    CASE WHEN passed THEN label || '需复核' || CASE WHEN review_reason IN ('', '需人工复核', 'needs_review') THEN '' ELSE '：' || review_reason END ELSE message END AS itext FROM risked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, ikind ORDER BY risk DESC, label, field_seq) AS kind_rank FROM issues WHERE ikind IS NOT NULL AND itext <> ''),
shown AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ikind, kind_rank) AS slot FROM ranked QUALIFY slot <= 4)"""

MERGED = f"""reviews AS (SELECT page_id, field_id, CASE page_id % 3 WHEN 0 THEN '3' ELSE '2024.01.02' END AS rvalue, CASE page_id % 3 WHEN 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS rconf FROM planned WHERE selected AND page_id % 3 < 2),
reread AS (SELECT p.*, rvalue, rconf, rvalue IS NOT NULL AS seen FROM planned p LEFT JOIN reviews r USING (page_id, field_id)),
renormal AS (SELECT *, CASE WHEN seen THEN {normal("coalesce(rvalue, '')")} ELSE '' END AS rnormal FROM reread),
judged AS (SELECT *, seen AND {passed(norm("coalesce(nullif(rnormal, ''), rvalue, '')"))} AS rpassed FROM renormal),
merged AS (
  SELECT page_id, field_id, seen AND rpassed AND rconf >= CAST(0.65 AS DOUBLE) AS accepted,
    CASE WHEN seen AND rpassed AND rconf >= CAST(0.65 AS DOUBLE) THEN rnormal ELSE normalized_value END AS normalized_value,
    passed OR (seen AND rpassed AND rconf >= CAST(0.65 AS DOUBLE)) AS passed,
    CASE WHEN seen AND rpassed AND rconf >= CAST(0.65 AS DOUBLE) THEN FALSE ELSE needs_review OR selected END AS needs_review,
    CASE WHEN seen AND rpassed THEN CASE WHEN rconf >= CAST(0.65 AS DOUBLE) THEN 'ROI复核通过' ELSE 'ROI复核置信度低于0.65，需人工确认' END
      WHEN seen THEN coalesce(nullif(review_reason, ''), 'ROI复核未通过') WHEN selected THEN coalesce(nullif(review_reason, ''), '缺少ROI复核图') ELSE review_reason END AS review_reason,
    seen AND {compact("coalesce(nullif(normalized_value, ''), value)")} <> '' AND {compact("coalesce(nullif(rnormal, ''), rvalue)")} <> '' AND {compact("coalesce(nullif(normalized_value, ''), value)")} <> {compact("coalesce(nullif(rnormal, ''), rvalue)")} AS changed
  FROM judged)"""


def oil_row(blocks: str) -> str:
    """The bottom row of bare numbers in the oil region: a recursive fold, one number of each page a step."""
    boxes = [f["assignment"]["search_bbox"] for f in SAMPLE if f["id"] in OIL_ROW]
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    x2, y2 = max(b[0] + b[2] for b in boxes), max(b[1] + b[3] for b in boxes)
    fits = "abs(u.cy - r.s / r.n) <= greatest(u.h, r.tall) * CAST(0.7 AS DOUBLE)"
    return f"""span AS (SELECT page_id, greatest(max(x2) * CAST(1.04 AS DOUBLE), CAST(1 AS DOUBLE)) / CAST(2400 AS DOUBLE) AS sx, greatest(max(y2) * CAST(1.04 AS DOUBLE), CAST(1 AS DOUBLE)) / CAST(1784 AS DOUBLE) AS sy FROM {blocks} GROUP BY page_id),
zone AS (SELECT page_id, {x} * sx AS zx1, {y} * sy AS zy1, {x2} * sx AS zx2, {y2} * sy AS zy2, greatest({x2} * sx - {x} * sx, CAST(1 AS DOUBLE)) AS zw, greatest({y2} * sy - {y} * sy, CAST(1 AS DOUBLE)) AS zh FROM span),
bare AS (
  SELECT b.*, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(y2 - y1, CAST(1 AS DOUBLE)) AS h FROM {blocks} b JOIN zone USING (page_id)
  WHERE {full(compact('text'), t.NUMBER)} AND (x1 + x2) / 2 BETWEEN zx1 - zw * CAST(0.25 AS DOUBLE) AND zx2 + zw * CAST(0.25 AS DOUBLE) AND (y1 + y2) / 2 BETWEEN zy1 - zh * CAST(0.15 AS DOUBLE) AND zy2 + zh * CAST(0.35 AS DOUBLE)),
turn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cy, block_seq) AS i, count(*) OVER (PARTITION BY page_id) AS n_all FROM bare),
fold AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS i, n_all, CAST([] AS STRUCT(n BIGINT, s DOUBLE, tall DOUBLE, ids BIGINT[])[]) AS found FROM turn WHERE n_all >= 3
  UNION ALL
  SELECT page_id, i, n_all, CASE WHEN place = 0 THEN list_append(found, {{'n': CAST(1 AS BIGINT), 's': cy, 'tall': h, 'ids': [CAST(block_seq AS BIGINT)]}})
      ELSE list_transform(found, lambda r, k: CASE WHEN k = place THEN {{'n': r.n + 1, 's': r.s + cy, 'tall': greatest(r.tall, h), 'ids': list_append(r.ids, CAST(block_seq AS BIGINT))}} ELSE r END) END
  FROM (SELECT u.*, found, coalesce(list_position(list_transform(found, lambda r: {fits}), TRUE), 0) AS place FROM fold JOIN turn u ON u.page_id = fold.page_id AND u.i = fold.i + 1)),
lines AS (SELECT page_id, unnest(found) AS r, unnest(range(1, len(found) + 1)) AS k FROM fold WHERE i = n_all),
lowest AS (SELECT page_id, r.ids AS ids FROM lines QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY r.s / r.n DESC, r.n DESC, k) = 1 AND r.n >= 3),
oil AS (SELECT u.*, row_number() OVER (PARTITION BY u.page_id ORDER BY cx, block_seq) AS pos FROM turn u JOIN lowest l ON u.page_id = l.page_id AND list_contains(ids, block_seq) QUALIFY pos <= {len(OIL_ROW)}),
oil_row AS (SELECT *, ({q(OIL_ROW)})[pos] AS field_id FROM oil)"""


def _two(x: str, name: str) -> str:
    """A positive number with two decimals, halves of its decimal form upward."""
    return f"CASE WHEN {x} > 0 THEN '{name}=' || CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(20, 17)), 2) AS DECIMAL(20, 2)) AS VARCHAR) END"


#: Candidates with the oil row in front; a block's second entry goes.
FULL = f"""{oil_row('blocks')},
every AS (
  SELECT page_id, field_id, block_id, block_seq, text, x1, y1, x2, y2, cy, rank, cand_score, concat_ws(',', {_two('overlap', 'overlap')}, CASE WHEN near THEN 'center_near' END, {_two('pattern_score', 'pattern')}) AS reason FROM resolved
  UNION ALL SELECT page_id, field_id, block_id, block_seq, text, x1, y1, x2, y2, cy, 0, score + 4, 'oil_pf_row_sequence' FROM oil_row),
single AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY page_id, field_id, block_id ORDER BY rank) = 1),
complete AS (SELECT * EXCLUDE (rank), CAST(row_number() OVER (PARTITION BY page_id, field_id ORDER BY rank) AS INTEGER) AS rank FROM single QUALIFY rank <= 8)"""


def evidence_box(image_w: int, image_h: int) -> str:
    """Pixels of an image no wider than twice its height that show a field; no candidate comes from the oil row here."""
    boxes = ", ".join("(" + ", ".join([q(f["id"]), *map(str, f["bbox"])]) + ")" for f in SAMPLE)
    numeric = "coalesce(kind = 'numeric', FALSE) OR validator IN ('digit_length', 'int_range')"
    precise = "roi_always OR roi_review OR prefer_roi OR coalesce(kind IN ('numeric', 'date'), FALSE) OR validator IN ('int_range', 'number_less_than')"
    over = lambda f, c: f"list_{f}(list_transform(cs[1:4], lambda c: c.{c}))"
    pixel = lambda c, least, most: f"greatest({least}, least({most}, CAST(round_even({c}, 0) AS INTEGER)))"
    return f"""own_box AS (SELECT * FROM (VALUES {boxes}) v(field_id, ox, oy, ow, oh)),
placed AS (
  SELECT m.page_id, m.field_id, page_w, page_h, {precise} AS precise, ({precise}) AND ({numeric}) AS exact, len(cs) > 0 AS has_cands, NOT ({precise}) AND len(cs) > 0 AS by_cands,
    ox * (page_w / CAST(2400 AS DOUBLE)) AS fx1, oy * (page_h / CAST(1784 AS DOUBLE)) AS fy1, (ox + ow) * (page_w / CAST(2400 AS DOUBLE)) AS fx2, (oy + oh) * (page_h / CAST(1784 AS DOUBLE)) AS fy2,
    {over('min', 'x1')} AS cx1, {over('min', 'y1')} AS cy1, {over('max', 'x2')} AS cx2, {over('max', 'y2')} AS cy2
  FROM messaged m JOIN extent USING (page_id) JOIN own_box USING (field_id)),
framed AS (
  SELECT *, CASE WHEN by_cands THEN cx1 ELSE fx1 END AS ax1, CASE WHEN by_cands THEN cy1 ELSE fy1 END AS ay1, CASE WHEN by_cands THEN cx2 ELSE fx2 END AS ax2, CASE WHEN by_cands THEN cy2 ELSE fy2 END AS ay2,
    CAST(CASE WHEN exact THEN 0.03 WHEN precise THEN 0.25 WHEN has_cands THEN 0.55 ELSE 0.35 END AS DOUBLE) AS l, CAST(CASE WHEN exact THEN 0.08 WHEN precise THEN 0.25 WHEN has_cands THEN 0.55 ELSE 0.35 END AS DOUBLE) AS v,
    CAST(CASE WHEN exact THEN 0.24 WHEN precise THEN 0.25 WHEN has_cands THEN 0.55 ELSE 0.35 END AS DOUBLE) AS r FROM placed),
scaled AS (
  SELECT page_id, field_id, (ax1 - greatest(ax2 - ax1, 1) * l) * sx AS gx1, (ay1 - greatest(ay2 - ay1, 1) * v) * sy AS gy1, (ax2 + greatest(ax2 - ax1, 1) * r) * sx AS gx2, (ay2 + greatest(ay2 - ay1, 1) * v) * sy AS gy2
  FROM (SELECT *, CAST({image_w} AS DOUBLE) / greatest(page_w, 1) AS sx, CAST({image_h} AS DOUBLE) / greatest(page_h, 1) AS sy FROM framed)),
corner AS (SELECT *, {pixel('gx1', 0, image_w - 1)} AS x, {pixel('gy1', 0, image_h - 1)} AS y FROM scaled),
boxed AS (SELECT page_id, field_id, x, y, {pixel('gx2', 'x + 1', image_w)} - x AS w, {pixel('gy2', 'y + 1', image_h)} - y AS h FROM corner)"""


#: Up to each step, all that it needs.
UPTO_TOP = f"WITH {MATCHED}"
UPTO_RESOLVED = f"{UPTO_TOP},\n{RESOLVED}"
UPTO_CHECKS = f"{UPTO_RESOLVED},\n{CLEANED}"
UPTO_FULL = f"{UPTO_RESOLVED},\n{FULL}".replace("WITH", "WITH RECURSIVE", 1)
UPTO_PLAN = f"{UPTO_CHECKS},\n{PLANNED}"
UPTO_ISSUES = f"{UPTO_PLAN},\n{RISK}"
#: The whole inspection without second readings: candidates with the oil row, and selected values wait for their image.
UNREAD = "unread AS (SELECT * REPLACE (needs_review OR selected AS needs_review, CASE WHEN selected THEN coalesce(nullif(review_reason, ''), '缺少ROI复核图') ELSE review_reason END AS review_reason) FROM planned)"
UPTO_REPORT = ",\n".join([UPTO_FULL, CLEANED.replace("FROM resolved GROUP", "FROM complete GROUP"), PLANNED, UNREAD, RISK.replace("FROM planned)", "FROM unread)")])

TASKS = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, o_orderpriority AS session_id, CAST(epoch(o_orderdate) AS DOUBLE) AS created_at, o_orderkey AS k, o_orderstatus AS s FROM orders),
tasks AS (
  SELECT task_id, session_id, created_at, k, CASE WHEN k % 5 = 0 THEN NULL ELSE created_at + 60 END AS started_at,
    CASE WHEN k % 5 <> 0 AND s = 'F' THEN created_at + 300 WHEN k % 5 <> 0 AND s = 'P' THEN created_at + 400 END AS finished_at,
    CASE WHEN k % 5 = 0 THEN 'pending' WHEN s = 'F' THEN 'done' WHEN s = 'P' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS attempt_count,
    CASE WHEN k % 5 = 0 THEN '{"stage": "pending", "status": "pending"}' WHEN s = 'F' THEN '{"stage": "final", "status": "done"}'
      WHEN s = 'P' THEN '{"stage": "error", "status": "failed", "error": "un\\"readable"}' WHEN k % 7 = 1 THEN '{"stage": "reading"}' ELSE '{"stage": "started", "status": "running"}' END AS progress,
    '/runs/' || task_id || '/upload.png' AS upload_url, CASE WHEN k % 5 <> 0 AND s = 'F' THEN '/runs/' || task_id || '/report.json' END AS report_url,
    CASE WHEN k % 5 = 0 OR s IN ('F', 'P') THEN NULL WHEN k % 7 = 1 THEN created_at + 90 + 1800 ELSE created_at + 60 + 1800 END AS lease_expires_at FROM o)"""

FAMILY_COUNTS = ", ".join(f"count(*) FILTER ({has('text', p)}) AS n_{n}" for n, p in profile.FAMILIES.items())


def guess_sql(name: str) -> str:
    family, x1, x2, y1, y2, _ = profile.GUESSES[name]
    bounds = [f"cx > {x1}" if x1 is not None else "", f"cx < {x2}" if x2 is not None else "", f"cy > {y1}" if y1 is not None else "", f"cy < {y2}" if y2 is not None else ""]
    return " AND ".join([has("text", profile.FAMILIES[family]), *filter(None, bounds)])


GUESSES = "[" + ", ".join(f"CASE WHEN {guess_sql(n)} THEN '{n}' END" for n in profile.GUESSES) + "]"
