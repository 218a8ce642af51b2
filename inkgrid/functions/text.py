"""Text normalisation as Column expressions. White space is Unicode's, as a `(?U)` pattern sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words printed on the form, patterns and spellings that decide results.
LABEL_WORDS = (
    "REPORTED BY", "REPORT/WORK", "AUTHORIZATION NO", "SERVICE COMPLETED", "AIRWORTHINESS RELEASE", "DEFERRED ITEM", "DEFER NO", "RELEASE SIGN", "LICENSE NO", "PIREP", "MAREP", "ACTIONS",
    "REF.", "P/N", "S/N", "报告者", "授权号", "完成维护类别", "保留项目", "放行签署", "执照号", "是否有保", "是否有保留", "日期", "地点", "参考手册", "处理措施", "保留单号", "第一联", "原始记录", "机组", "机务",
    "安装件号", "拆下件号", "拆下序号", "安装序号", "功能号", "工作者签名",
)
LABEL_WHOLE_WORDS = ("FIN", "SIGN", "DATE", "STATION")
NAME_NOISE = (
    "报告者", "报告人", "工作者签名", "放行签署", "签名", "SIGN", "REPORTEDBY", "RELEASESIGN", "SIGNPRESENT", "S/NON", "S/NOFF", "P/NON", "P/NOFF", "SNON", "SNOFF", "PNON", "PNOFF",
)
NAME_NOISE_PARTS = ("S/N", "P/N", "AUTHORIZATION", "RELEASE", "STATION", "DATE")
STATION = "重庆"
STATION_SPELLINGS = ("重庆", "渝", "chongqing", "chungking")
CHECKED_WORDS = ("true", "checked", "yes", "1", "勾选", "已勾选")
DROPPED_WORDS = ("FAULT", "FAULTMSG", "FAULTMSGE", "MESSAGE", "MSG")
NUMBER = r"[0-9]+(?:[.][0-9]+)?"
#: What casts to a double, and nothing else: a cast that fails is an exception, which takes long.
DOUBLE = r"(?i)\A[\x00-\x20]*[+-]?(?:nan|inf(?:inity)?|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?|(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?[fd]?)[\x00-\x20]*\z"
DATE_INSIDE = r"20[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}"
CJK = r"[一-鿿]"
#: White space as Unicode has it, which is what a `(?U)` pattern's `\\s` matches.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a pattern; printed ASCII and all beyond U+3000 are told by two ranges, before the signs are asked one by one.
BLANK = f"[[^!-~\u3001-\uffff]&&[{SPACE}]]+"
AUTHORIZATION_PATTERN = "^[0-9]{6}$"
LICENSE_PATTERN = "^CAACML[0-9]{8}$"


def whole(c: Column, pattern: str) -> Column:
    """Whether all of the text matches (no newline is forgiven at the end)."""
    return c.rlike(rf"\A(?:{pattern})\z")


def strip(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))


def first_filled(a: Column, b: Column) -> Column:
    """The first of two texts that is neither null nor empty, else empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def _half_width(c: Column) -> Column:
    # By `replace`, which leaves a text without the sign as it is: `translate` takes texts apart, sign by sign.
    return F.replace(F.replace(c, F.lit("："), F.lit(":")), F.lit("／"), F.lit("/"))


def normalized(c: Column) -> Column:
    return _half_width(strip(c))


def compact(c: Column) -> Column:
    """The normalised text without any white space."""
    return _half_width(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, ""))


def _is_na(bare: Column) -> Column:
    return whole(F.upper(bare), "[/-]*N[/-]*A[/-]*")


def with_na(c: Column) -> Column:
    return F.when(_is_na(compact(c)), F.lit("N/A")).otherwise(normalized(c))


def with_station(c: Column) -> Column:
    return F.when(F.lower(compact(c)).isin(*STATION_SPELLINGS), F.lit(STATION)).otherwise(normalized(c))


def exact_value(c: Column) -> Column:
    """N/A in any spelling is N/A, the station in any spelling is the station, else the normalised text."""
    bare = compact(c)
    return F.when(_is_na(bare), F.lit("N/A")).when(F.lower(bare).isin(*STATION_SPELLINGS), F.lit(STATION)).otherwise(normalized(c))


def comparable_bare(bare: Column) -> Column:
    """What `comparable` makes of a compact text."""
    lower = F.lower(bare)
    return F.when(_is_na(bare), F.lit("n/a")).when(lower.isin(*STATION_SPELLINGS), F.lit(STATION)).otherwise(lower)


def comparable(c: Column) -> Column:
    """The exact value without white space, in lower case."""
    return comparable_bare(compact(c))


def date_text(c: Column) -> Column:
    """A date as yyyy-MM-dd: by `.`, `/` or `-`, with a two-digit year, without separators, or found inside; else the text."""
    text = F.translate(normalized(c), "./", "--")
    month, day = "(1[0-2]|0[1-9]|[1-9])", "(3[01]|[12][0-9]|0[1-9]|[1-9])"

    def built(pattern: str, century: str = "") -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
        made = F.concat(F.lit(century), y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
        return F.date_format(F.try_to_timestamp(F.when(y != "", made), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")

    loose = r"(20[0-9]{2})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})"
    parts = [F.regexp_extract(text, loose, k) for k in (1, 2, 3)]
    inside = F.when(parts[0] != "", F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))
    return F.coalesce(built(rf"\A([0-9]{{4}})-{month}-{day}\z"), built(rf"\A([0-9]{{2}})-{month}-{day}\z", "20"), built(rf"\A([0-9]{{4}}){month}{day}\z"), inside, text)


SIX_DIGITS = r"(?<![0-9])([0-9]{6})(?![0-9])"


def last_six_digits(c: Column) -> Column:
    """The last run of exactly six digits, or empty."""
    found = F.regexp_extract_all(c, F.lit(SIX_DIGITS), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def for_pattern(c: Column, pattern: Column) -> Column:
    """The part of the text that a rule's pattern is about."""
    text = normalized(c)
    bare = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    licence = F.coalesce(F.nullif(F.regexp_extract(bare, "(CAACML[0-9]{8})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, "(CAAC[A-Z]*[0-9]{8})", 1), F.lit("")))
    return F.coalesce(
        F.when(pattern == AUTHORIZATION_PATTERN, F.nullif(last_six_digits(text), F.lit(""))),
        F.when(pattern == LICENSE_PATTERN, licence),
        bare,
    )


def is_number(c: Column) -> Column:
    return whole(compact(c), NUMBER)


def is_bare_date(bare: Column) -> Column:
    return whole(bare, rf"{DATE_INSIDE}|20[0-9]{{6}}")


def is_date(c: Column) -> Column:
    return is_bare_date(compact(c))


def _label_pattern() -> str:
    """The words by their first letter, which is asked before any word is tried: most places of a text hold none of them."""
    tails: dict[str, list[str]] = {}
    for word in LABEL_WORDS:
        tails.setdefault(word[0], []).append(word[1:].replace(".", "[.]"))
    for word in LABEL_WHOLE_WORDS:
        tails.setdefault(word[0], []).append(f"(?<![A-Z].){word[1:]}(?![A-Z])")
    # All other first letters are CJK, told by one range.
    return f"(?=[{''.join(c for c in tails if c < '一')}一-鿿])(?:{'|'.join(f'{head}(?:{"|".join(rest)})' for head, rest in tails.items())})"


LABEL = _label_pattern()


def is_label(c: Column) -> Column:
    """Whether the text holds words printed on the form; four short ones count only as whole words."""
    return F.upper(c).rlike(LABEL)


def is_release_statement(c: Column) -> Column:
    return F.upper(c).contains("CONSIDERED FIT FOR RELEASE") | c.contains("适合飞行") | c.contains("满足适航要求")


def is_body(c: Column) -> Column:
    """Whether the text reads like a report's body: no label, date, N/A, place, number or reference; long enough."""
    text, upper = strip(c), F.upper(compact(c))
    return (
        (text != "")
        & ~is_label(text)
        & ~whole(upper, DATE_INSIDE)
        & ~upper.isin("N/A", "NA", "MA", "M/A")
        & ~text.isin("渝", STATION)
        & ~whole(upper, NUMBER)
        & ~whole(upper, r"(?U)[A-Z]{2,}[0-9][\w./-]*")
        & ((F.regexp_count(text, F.lit(CJK)) >= 4) | (F.regexp_count(text, F.lit("[A-Za-z]")) >= 12))
    )


def english_only(c: Column) -> Column:
    """The words that have a Latin letter, without CJK and full-width signs and without the message caption."""
    cleaned = F.transform(F.split(strip(c), r"(?U)\s+"), lambda w: strip(F.regexp_replace(F.regexp_replace(w, rf"{CJK}+|[　-〿＀-￯]+", " "), r"(?U)\s+", " ")))
    kept = F.filter(cleaned, lambda w: w.rlike("[A-Za-z]") & ~F.upper(w).isin(*DROPPED_WORDS))
    return F.array_join(kept, " ")


def digits_or_empty(c: Column) -> Column:
    return F.when(whole(compact(c), "[0-9]+"), compact(c)).otherwise(F.lit(""))


def problem_key(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), SPACE, "")


def without_index(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^[0-9. 、-]+", "")


def session_id(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(strip(c), 1, 80), F.lit("")), F.lit("default"))


def unfenced(c: Column) -> Column:
    """A model's answer without the fence of a code block around it."""
    return strip(F.regexp_replace(strip(c), r"(?is)\A```(?:json)?|```\z", ""))


def json_inside(c: Column) -> Column:
    """What a model's answer holds between its first and last brace; null without any."""
    return F.nullif(F.regexp_extract(c, r"(?s)([{].*[}])", 1), F.lit(""))
