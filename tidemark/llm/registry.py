"""The queries of this package and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, license_scan, packing, prefix_trie, quality_crf, resample, simhash, token_counts, token_ids, url_filter, warc
from .common import new_path, read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_format.with_probe(read(spark, sf_dir, "conversations"))
    found = chat_format.places(conversations)
    short, long = (chat_format.windows(conversations, found=found, part=part) for part in ("short", "long"))
    # conversations of one segment lie in one task already
    return chat_format.read_back(short, in_place=True).unionByName(chat_format.read_back(long))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), license_scan.templates_table(spark))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_back(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = token_counts.rendered(read(spark, sf_dir, "documents"), ["lang", "source", "text"], between=" ")
    return token_counts.attribute(documents, sections_col="sections", rule="most")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_license_scan": op2_license_scan,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_warc_archive": op4_warc_archive,
        "op5_token_counts": op5_token_counts,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_ids": op12_token_ids,
        "op13_importance_resampling": op13_importance_resampling,
    }


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)
), i AS (
  SELECT item_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS at
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
), m AS (
  SELECT doc_id, item_id, size, d.at - i.at AS start, i.at AS pos FROM d JOIN i ON d.word = i.word
), least AS (
  SELECT *, CASE WHEN size < 7 THEN size ELSE ceil(least(15, size) * 0.8) END AS need, count(*) OVER (PARTITION BY doc_id, item_id, size, start) AS total FROM m
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, size, start ORDER BY pos RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS run FROM least WHERE total >= need
)
SELECT doc_id, item_id, CAST(max(total) AS INTEGER) AS equal_words, CAST(max(size) AS INTEGER) AS item_words FROM runs WHERE run >= need GROUP BY doc_id, item_id
"""

OP4_SQL = r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h
"""

OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(v, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT host, path, arg_max(v, length(h) + length(p)) AS v, arg_max(h || p, length(h) + length(p)) AS rule
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, s.host AS host, s.path AS path, rule, coalesce(v, 'allow') AS verdict FROM split s LEFT JOIN fit f ON s.host = f.host AND s.path = f.path
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""

#: The crc32 of a text, a byte at a time, by a table of the 256 bytes.
CRC_TABLE = "tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_transform(range(octet_length(encode({}))), lambda i: CAST('0x' || substr(hex(encode({})), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

OP11_SQL = r"""
WITH @TABLE@, own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS w FROM conversations GROUP BY conv_id
), h AS (
  SELECT c, w, @CRC@ % 4 AS h FROM own, tbl
), rebuilt AS (
  SELECT h.c, list_concat(list_slice(coalesce(b.w, []), 1, h), list_slice(h.w, h + 1, len(h.w))) AS w FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20
), member AS (
  SELECT c, d, len(w) = d AS ends, list_slice(w, 1, d) AS path FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM member GROUP BY path, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.d = n.d + 1 AND list_slice(k.path, 1, n.d) = n.path) AS n_children FROM node n LEFT JOIN node p ON p.d = n.d - 1 AND p.path = list_slice(n.path, 1, n.d - 1)
)
SELECT a.conv_id, a.d AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM linked a JOIN linked b ON b.d >= a.d AND list_slice(b.path, 1, a.d) = a.path GROUP BY a.conv_id, a.d
""".replace("@TABLE@", CRC_TABLE).replace("@CRC@", CRC.format("CAST(c AS VARCHAR)", "CAST(c AS VARCHAR)"))

OP13_SQL = r"""
WITH @TABLE@, w AS (
  SELECT true AS own, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT false, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), f AS (
  SELECT own, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w
), n AS (SELECT own, id, f, count(*) AS n FROM f GROUP BY own, id, f),
k AS (SELECT f, @CRC@ % 10000 AS b FROM (SELECT DISTINCT f FROM n), tbl),
p AS (SELECT own, id, b, sum(n) AS n FROM n JOIN k USING (f) GROUP BY own, id, b),
g AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM p GROUP BY b),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
gain AS (SELECT b, floor(1000 * ln(CAST(g.t + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE) / (CAST(g.s + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS gain FROM g, z),
d AS (SELECT id, sum(n) AS size, floor(sum(n * gain) / sum(n)) AS weight FROM p JOIN gain USING (b) WHERE own GROUP BY id),
e AS (
  SELECT doc_id, len(w) AS words, CAST(coalesce(size, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents JOIN w ON own AND w.id = doc_id LEFT JOIN d ON d.id = doc_id
), r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (words >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM r
""".replace("@TABLE@", CRC_TABLE).replace("@CRC@", CRC.format("f", "f"))


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": OP3_SQL,
        "op4_warc_archive": OP4_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
