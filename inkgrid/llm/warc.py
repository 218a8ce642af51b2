"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A derivative names its source in WARC-Refers-To and repeats the source's URI, date, HTTP headers and digests, as they came.
Records are rows; `write` lays them out as WARC/1.1 files and `read` takes WARC/1.1 files apart.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid.llm.words import slices

VERSION = "WARC/1.1"
END = "\r\n"
#: The date of a source that has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: What a response record has; the identifier and the digests may be null, or their columns missing.
SOURCE = ("page_id", "target_uri", "warc_date", "http_headers", "payload", "record_id", "block_digest", "payload_digest")
DERIVED_SCHEMA = (
    "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, block string"
)

HIDDEN = ("script", "style", "template", "noscript")
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer blockquote pre title main aside form dd dt dl hr".split())
#: A comment's start, the start of a tag, or a declaration; what a tag has besides its name is read by `_tag_end`.
_mark = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s<>/]*+)|[!?][^<>]*+>)""")
_unquoted = re.compile(r"""[^<>"']*+""")
_ends = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_href, _lang = (re.compile(rf"""(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I) for name in ("href", "lang"))
_spaces = re.compile(r"[^\S\n]+")


class Page(NamedTuple):
    text: str
    title: str | None
    language: str | None
    links: list[str]


def _value(pattern: re.Pattern, attributes: str) -> str | None:
    m = pattern.search(attributes)
    return html.unescape(next(g for g in m.groups() if g is not None)) if m else None


def _tag_end(page: str, pos: int, dead: dict[int | str, int]) -> int:
    """Where the tag whose name ends at `pos` has its `>`; -1 if a `<` outside quotes or the end of the page comes first.

    Quoted values may be of any length. `dead` holds the quotes from which no tag was closed, and where a sign stands last once
    that is known, so that all calls for a page together take linear time.
    """
    seen = []
    while True:
        pos = _unquoted.match(page, pos).end()
        sign = page[pos : pos + 1]
        if sign == ">":
            return pos
        known = sign not in ("'", '"') or pos in dead or pos >= dead.get(sign, len(page))
        close = -1 if known else page.find(sign, pos + 1)
        if close < 0:
            dead.update(dict.fromkeys(seen, -1) if known else {**dict.fromkeys(seen, -1), sign: pos})
            return -1
        seen.append(pos)
        pos = close + 1


def parsed(page: str) -> Page:
    """The readable text of an HTML page, its title, language and links, in one pass over its marks.

    Scripts, styles, templates, what stands in their place, comments and declarations go; blocks end lines; entities are resolved.
    An element or comment that never ends is not hidden: its mark goes (a comment's stays) and the rest is read on.
    """
    out, links, unended, dead = [], {}, set(), {}
    pos, title, language, title_from = 0, None, None, None
    while m := _mark.search(page, pos):
        comment, closing, name = m.groups()
        end = _tag_end(page, m.end(), dead) if name else m.end()
        if end < 0:
            out.append(page[pos : m.start() + 1])
            pos = m.start() + 1
            continue
        out.append(page[pos : m.start()])
        attributes, pos = page[m.end() : end], end + 1 if name else end
        if comment:
            end = -1 if comment in unended else page.find("-->", pos)
            if end < 0:
                unended.add(comment)
            pos = end + 3 if end >= 0 else pos
            out.append(" " if end >= 0 else m[0])
            continue
        if name is None:
            out.append(" ")
            continue
        name = name.lower()
        if name in _ends and not closing and name not in unended:
            if end := _ends[name].search(page, pos):
                pos = end.end()
                out.append(" ")
                continue
            unended.add(name)
        if name in BREAKS:
            out.append("\n")
        if closing:
            if name == "title" and title_from is not None and title is None:
                title = " ".join(html.unescape("".join(out[title_from:])).split())
        elif name == "title" and title_from is None:
            title_from = len(out)
        elif name == "html" and language is None:
            language = _value(_lang, attributes)
        elif name == "a" and (link := _value(_href, attributes)) is not None:
            links[link] = None
    out.append(page[pos:])
    lines = (_spaces.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
    return Page("\n".join(line for line in lines if line), title, language, list(links))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that hangs on its parts only, so that a rerun or a retried task gives the same."""
    h = hashlib.sha256("\x00".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages (page_id, url, html): page_id, target_uri, warc_date, http_headers, payload.

    The pages carry no HTTP headers; the least that describes them is put in front. Null urls and bodies count as empty.
    """
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"), body.alias("payload"))


def _derive(page_id, uri, date, head, payload, source, block_digest, payload_digest, turn) -> Iterator[tuple]:
    uri, date, head, payload = uri or "", date or NO_DATE, head or "", payload or ""
    own = digest(f"{head}{END}{payload}".encode())
    block_digest, payload_digest = block_digest or own, payload_digest or digest(payload.encode())
    source = source or record_id("response", str(page_id), uri, date, own, str(turn))
    page = parsed(payload)
    lines = head.split(END)
    fields = [f"source-http-{line}" for line in lines if ":" in line] + [f"source-status: {lines[0]}"]
    fields += [f"source-block-digest: {block_digest}", f"source-payload-digest: {payload_digest}"]
    fields += [f"{name}: {value}" for name, value in (("title", page.title), ("languageOfPage", page.language)) if value is not None]
    fields += [f"outlink: {' '.join(x.split())}" for x in page.links] + [f"conversion-block-digest: {digest(page.text.encode())}"]
    about = "".join(f + END for f in fields)
    for kind, content_type, content in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", page.text)):
        raw = content.encode()
        yield page_id, kind, record_id(kind, source, str(page_id), own, str(turn)), source, uri, date, content_type, len(raw), digest(raw), block_digest, payload_digest, content


def numbered_repeats(records: DataFrame) -> DataFrame:
    """Adds `turn`, which tells equal rows apart (0, 1, ...); all 0, without a shuffle of the rows, where none can be equal.

    A row that very many others equal is counted in each partition first, so that no task gets all of them.
    """
    light = [F.col(c) for c in ("record_id", "page_id", "target_uri", "warc_date")]
    if not records.select(F.xxhash64(*light).alias("k")).groupBy("k").count().filter("count > 1").limit(1).count():
        return records.withColumn("turn", F.lit(0).cast("long"))
    rows = records.withColumns({"__key": F.xxhash64(*records.columns), "__part": F.spark_partition_id()})
    counts = rows.groupBy("__key", "__part").count()
    before = F.sum("count").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__key", "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("__key", "__part").orderBy("page_id")) - 1)
    return rows.join(starts, ["__key", "__part"]).withColumn("turn", F.col("turn") + F.col("__start")).drop("__key", "__part", "__start")


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion, both linked to it.

    Rows carry SOURCE. An identifier or digest that is given is kept as it is; one that is null, or whose column is missing,
    is made from the content. Null URIs, headers and payloads count as empty, a null date as NO_DATE. Every derivative has an
    identifier of its own, repeated responses too. Empty pages have an empty conversion; no rows give no rows.
    """
    names = [f.split()[0] for f in DERIVED_SCHEMA.split(", ")]
    kinds = [pa.int64() if f.split()[1] == "bigint" else pa.string() for f in DERIVED_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SOURCE.index("payload")):
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in _derive(*row)]
            columns = list(zip(*made)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    held = records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in SOURCE])
    return numbered_repeats(held).select(*SOURCE, "turn").mapInArrow(run, DERIVED_SCHEMA)


def layout(records: DataFrame) -> Column:
    """A derived record as WARC text without the two line ends that close it; a header value keeps to one line, an empty one goes."""
    one = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
    line = lambda name, c: F.when(one(c) == "", "").otherwise(F.concat(F.lit(f"{name}: "), one(c), F.lit(END)))
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    return F.concat(F.lit(VERSION + END), *[line(n, c) for n, c in named], F.lit(END), F.col("block"))


def write(records: DataFrame, path: str) -> None:
    """Derived records as WARC/1.1 files, one for each partition."""
    records.select(layout(records).alias("value")).write.option("lineSep", END + END).mode("overwrite").text(path)


READ_SCHEMA = "headers map<string,string>, block binary, complete boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC/1.1 files: headers (the first of a name), block, and whether it has the length stated.

    Files are split at version lines. A version line inside a block is no record's start: blocks are put together again until
    they have their length, within a split of a file.
    """
    mark = (VERSION + END).encode()
    rows = spark.read.option("lineSep", VERSION + END).text(path).select(F.col("value").cast("binary"), F.concat_ws(" ", "_metadata.file_path", "_metadata.file_block_start").alias("at"))

    def parts(data: bytes) -> tuple[dict, bytes, int | None]:
        head, _, rest = data.partition(b"\r\n\r\n")
        headers: dict[str, str] = {}
        for line in head.decode(errors="replace").split(END):
            name, _, value = line.partition(":")
            headers.setdefault(name.strip(), value.strip())
        length = headers.get("Content-Length", "")
        return headers, rest, int(length) if length.isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = None, None

        def made(found: list[bytes]) -> pa.RecordBatch:
            out = [(h, r if n is None else r[:n], n is not None and len(r) >= n) for h, r, n in map(parts, found)]
            maps = pa.array([list(h.items()) for h, _, _ in out], pa.map_(pa.string(), pa.string()))
            return pa.RecordBatch.from_arrays([maps, pa.array([b for _, b, _ in out], pa.binary()), pa.array([c for _, _, c in out], pa.bool_())], names=["headers", "block", "complete"])

        for batch in batches:
            done = []
            for data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None:
                    _, rest, length = parts(held)
                    longer = held + mark + data
                    if at == where and length is not None and len(rest) < length and len(parts(longer)[1]) <= length + 4:
                        held = longer
                        continue
                    done.append(held)
                held, where = (data, at) if data.strip() else (None, at)
            yield made(done)
        if held is not None:
            yield made([held])

    return rows.mapInArrow(run, READ_SCHEMA)


def responses_of(records: DataFrame) -> DataFrame:
    """What `read` gives as SOURCE rows: the response records, with their identifiers, dates and digests; bytes that are no UTF-8 are replaced."""
    head = lambda name: F.col("headers")[name]
    text = F.make_valid_utf8(F.col("block").cast("string"))
    at = F.locate(END + END, F.col("text"))
    rows = records.filter(head("WARC-Type") == "response").withColumn("text", text)
    return rows.select(
        F.lit(None).cast("bigint").alias("page_id"),
        head("WARC-Target-URI").alias("target_uri"),
        head("WARC-Date").alias("warc_date"),
        F.when(at > 0, F.substring(F.col("text"), F.lit(1), at + 1)).otherwise("").alias("http_headers"),
        F.when(at > 0, F.substring(F.col("text"), at + 4, F.char_length("text"))).otherwise(F.col("text")).alias("payload"),
        head("WARC-Record-ID").alias("record_id"),
        head("WARC-Block-Digest").alias("block_digest"),
        head("WARC-Payload-Digest").alias("payload_digest"),
    )
