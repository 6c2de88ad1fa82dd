"""The registered corpus queries. Each applies its operator to a whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import table
from lodeline.llm.conversation_trie import conversation_trie
from lodeline.llm.decontamination import find_items
from lodeline.llm.license_scan import scan_licenses
from lodeline.llm.line_dedup import drop_repeated_lines
from lodeline.llm.mixing import plan_mix
from lodeline.llm.ngram_join import jaccard_join
from lodeline.llm.packing import pack
from lodeline.llm.quality_classifier import score_quality
from lodeline.llm.quality_rules import quality_rules
from lodeline.llm.resampling import resample
from lodeline.llm.token_counts import count_tokens
from lodeline.llm.token_files import read_tokens, write_tokens
from lodeline.llm.url_rules import judge_urls

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
PACK_END_ID = 0
#: The rules that the query over pages judges by.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def tokenizer() -> bytes:
    with open(public_tokenizers.path(TOKENIZER), "rb") as f:
        return f.read()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), listed=False)[0].drop("set")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer(), END_ID))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels"))).drop("score")


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a source is a repository, with a directory for each language
    return scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")), "path")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).drop("kept")


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer(), PACK_END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard_join, op2_token_files, op3_benchmark_decontamination, op4_source_mixing, op5_quality_rules,
        op6_url_rules, op7_license_scan, op8_token_counts, op9_quality_classifier, op10_line_dedup,
        op11_sequence_packing, op12_importance_resampling, op13_conversation_trie,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _crc_table() -> list[int]:
    """The remainders of all bytes, which DuckDB has no function for."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    step = f"xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295::BIGINT)"


SQL = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM s JOIN c ON s.doc_id = c.a LEFT JOIN k ON s.doc_id = k.a""",
    "op4_source_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    md5(doc_id::VARCHAR || '/' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM t WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT rest, open FROM o WHERE weight * rest <= 3 * source_size * open ORDER BY open DESC LIMIT 1),
g AS (
  SELECT source, source_size, least((weight * lv.rest)::DOUBLE / lv.open::DOUBLE, (3 * source_size)::DOUBLE) AS target FROM o, lv),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
f AS (SELECT *, floor(rate) AS whole, floor((rate - floor(rate)) * 4294967296) AS part FROM q),
e AS (
  SELECT d.*, f.source_size, f.target, f.whole, f.part, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k AS (
  SELECT source, k, sum(CASE WHEN (h1 + h2 * k) % 4294967296 < part THEN size ELSE 0 END) AS drawn
  FROM e, range(64) AS ks(k) GROUP BY source, k),
b AS (
  SELECT k.source, k.k FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
  QUALIFY row_number() OVER (PARTITION BY k.source ORDER BY abs(drawn::DOUBLE - (target - whole * source_size)), k.k) = 1)
SELECT e.doc_id, e.size, e.source_size, e.target,
  CASE WHEN e.target > 0 THEN e.size * (e.whole::BIGINT + CASE WHEN (h1 + h2 * b.k) % 4294967296 < part THEN 1 ELSE 0 END) ELSE 0 END
    ::BIGINT AS taken
FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source""",
    "op6_url_rules": f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
m AS (
  SELECT page_id, h || p AS rule, v FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) = 1)
SELECT x.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN m ON x.page_id = m.page_id""",
    "op10_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_importance_resampling": f"""
WITH w AS (
  SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') FROM benchmark),
x AS (SELECT side, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM w),
f AS (
  SELECT side, doc_id, unnest(flatten([
    ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')),
    list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))])) AS f FROM x),
k AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT side, doc_id, bucket, count(*) AS n FROM f JOIN k USING (f) GROUP BY ALL),
h AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t
  FROM range(10000) AS r(b) LEFT JOIN c ON c.bucket = b GROUP BY b),
a AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM h),
g AS (
  SELECT bucket, floor(1000 * ln(((h.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE) / ((h.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM h, a),
z AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
o AS (
  SELECT x.doc_id, len(ws) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || x.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM x LEFT JOIN z USING (doc_id) WHERE side = 'd'),
p AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) FILTER (fit) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 5 * n // 100 THEN r END AS rank FROM p""",
    "op13_conversation_trie": f"""
WITH t AS (
  SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'id': id, 'w': words}} ORDER BY turn NULLS FIRST, id) AS own, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS q FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d AS depth, q[1:d] AS q, d = len(q) AS ends FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM r)),
n AS (
  SELECT q, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY q, depth),
k AS (SELECT q[1:depth - 1] AS q, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * n.q[n.depth].w ELSE 0 END AS saved
  FROM n LEFT JOIN k ON n.depth = k.depth AND n.q = k.q),
u AS (SELECT q[1:a] AS q, a AS depth, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v)),
s AS (SELECT q, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY q, depth)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON v.depth = s.depth AND v.q = s.q LEFT JOIN v p ON p.depth = v.depth - 1 AND p.q = v.q[1:v.depth - 1]""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
