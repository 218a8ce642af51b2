"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import collocations, decontaminate, fingerprints, license_scan, mixing, ngram_join, quality, resampling, sentencepiece_codec, sharding, suffix_dedup, url_filter, warc
from inkgrid.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("words")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op13, what SQL can say too: targets in thousandths, and that the words taken come near."""
    rows = op13_mixing(spark, sf_dir)
    by_source = rows.groupBy("source_size", "target").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    near = F.abs(F.col("taken") - F.col("target")) < 2 * mixing.BLOCK_WORDS
    return by_source.select("source_size", F.round(F.col("target") * 1000).cast("long").alias("target"), "rows", "words", near.alias("near"), (F.col("over") <= 0).alias("within"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5, what SQL can say too."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8, what SQL can say too."""
    rows = op8_url_filter(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10, what SQL can say too: sizes, and how many rows each shard has."""
    rows = op10_sharding(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), (F.max("slot") + 1).alias("slots")).join(rows.agg(F.sum("size").alias("total_size")))


PER_OPERATOR = (op1_ngram_join, op2_sentencepiece, op3_quality, op4_license_scan, op5_fingerprints, op6_decontamination, op7_warc, op8_url_filter, op9_suffix_dedup, op10_sharding, op11_resampling, op12_collocations, op13_mixing)
QUERIES = {f.__name__: f for f in (*PER_OPERATOR, edited_texts, url_rules, shard_sizes, mix_targets)}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FITS = [(what, host + path, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')") for what, host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))]
ORACLE_SQL: dict[str, str] = {
    "edited_texts": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, n, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(other, 1, n // 2)) AS edited_sha256 FROM e""",
    "url_rules": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits} THEN '{name}'" for _, name, fits in _FITS)} END AS rule, CASE {' '.join(f"WHEN {fits} THEN '{what}'" for what, _, fits in _FITS)} END AS by_rule FROM p""",
    "shard_sizes": """
WITH n AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 8) AS BIGINT) AS total_size FROM documents)
SELECT CAST(s AS INTEGER) AS shard, CAST(n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END AS BIGINT) AS rows, CAST(n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END AS BIGINT) AS slots, total_size FROM n, range(24) r(s)""",
    "op11_resampling": rf"""
WITH RECURSIVE half(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM half WHERE k < 8),
step AS (SELECT i, c FROM half WHERE k = 8),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM (SELECT 'raw' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'target', item_id, text FROM benchmark)),
g AS (SELECT side, id, f, count(*) AS n FROM (
    SELECT side, id, unnest(ws) AS f FROM w UNION ALL SELECT side, id, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w) GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
crc(f, x, p, c) AS (SELECT f, x, 0, CAST(4294967295 AS BIGINT) FROM h
    UNION ALL SELECT f, x, p + 1, xor(r.c >> 8, step.c) FROM crc r JOIN step ON step.i = xor(r.c & 255, CAST('0x' || substr(x, 2 * p + 1, 2) AS BIGINT)) WHERE 2 * p < len(x)),
b AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * p = len(x)),
c AS (SELECT side, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM g JOIN b USING (f) GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'target'), 0) AS t, coalesce(sum(n) FILTER (side = 'raw'), 0) AS s FROM (SELECT side, bucket, n FROM c UNION ALL SELECT 'raw', i, 0 FROM range(10000) r(i)) GROUP BY bucket),
a AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM k) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM k) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM k),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN a USING (bucket) WHERE side = 'raw' GROUP BY id),
z AS (SELECT id AS doc_id, len(ws) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN d USING (id) WHERE side = 'raw'),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE may)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (doc_id)""",
    "op12_collocations": rf"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, phrase, m, count(*) AS f FROM ({' UNION ALL '.join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, greatest(len(ws) - {m - 2}, 1)), lambda i: array_to_string(ws[i:i + {m - 1}], ' '))) AS phrase FROM w" for m in range(1, 6))}) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.lang, c.phrase, c.m, a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN n ON n.lang = c.lang
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN f ON f.lang = s.lang AND f.m > s.m AND f.f >= s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s ANTI JOIN d USING (lang, phrase) QUALIFY rank <= 2000""",
    "mix_targets": r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size, count(*) AS rows, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * size / w AS ratio, coalesce(sum(3 * size) OVER b, 0) AS capped, sum(w) OVER a AS open FROM s
    WINDOW b AS (ORDER BY 3 * size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY 3 * size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
m AS (SELECT arg_min(((SELECT sum(size) FROM s) - capped) / open, ratio) FILTER (((SELECT sum(size) FROM s) - capped) / open <= ratio) AS unit FROM r)
SELECT CAST(size AS BIGINT) AS source_size, CAST(round(1000 * least(3 * size, w * unit)) AS BIGINT) AS target, sum(rows)::BIGINT AS rows, sum(size)::BIGINT AS words, true AS near, true AS within FROM s, m GROUP BY size, least(3 * size, w * unit)""",
    "op9_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS p FROM t)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
s AS (SELECT doc_id, p, lag(p) OVER d AS before, lead(p) OVER d AS after FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
e AS (SELECT *, min(CASE WHEN after IS NULL OR after > p + 100 THEN p + 99 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM s),
runs AS (SELECT doc_id, p AS first, last, lag(last) OVER (PARTITION BY doc_id ORDER BY p) AS ended FROM e WHERE before IS NULL OR p > before + 100),
k AS (SELECT t.doc_id, count(*) AS n_spans, sum(last - first + 1) AS n_removed,
    string_agg(substr(h, 2 * coalesce(ended, 0) + 1, 2 * (first - 1 - coalesce(ended, 0))), '' ORDER BY first) || substr(any_value(h), 2 * max(last) + 1) AS kept FROM t JOIN runs USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)""",
    "op1_ngram_join": r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS k, count(*) AS n_copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
w AS (SELECT k, list_filter(regexp_split_to_array(text, '[\x00-\x20]+'), lambda x: x <> '') AS ws FROM t),
s AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT k, count(*) AS m FROM s GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.k < y.k GROUP BY x.k, y.k),
l AS (SELECT a, b FROM p JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE 10 * n >= 8 * (x.m + y.m - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k AS node, k AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
g AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies, t.k AS first_copy
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN g ON g.node = t.k LEFT JOIN n ON n.a = t.k""",
}
