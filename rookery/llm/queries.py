"""One query per operator, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import bpe, embeddings, filter_audit, mixing, near_dup, pieces, pii, prefix_trie, quality, repeats, sharding, token_files, urls
from rookery.llm.storage import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    taken = F.col("copies") * F.col("size") + F.col("part")
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), "copies", "part")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_files.read_token_files(spark, path).drop("ids")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def joined(kinds: tuple[str, ...]) -> Column:
        text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), text), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(pii.KINDS).cast("binary"), 256).alias("base_sha256"), joined(pii.ORDER).alias("spans"), count("term"), F.size("spans").cast("long").alias("n_spans"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), decode=True)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents"), piece_model_path(), end_id=2, decode=True)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_sources, op2_token_files, op3_near_duplicates, op4_personal_data, op5_near_vectors, op6_quality_rules, op7_url_rules, op8_repeated_passages, op9_bpe_round_trip, op10_byte_shards, op11_piece_round_trip, op12_prefix_trie, op13_filter_audit]
    return {f.__name__: f for f in found}


#: DuckDB SQL for the rows of queries, where SQL can express them. The given pages have no redirect or canonical links, so there a
#: page without a rule is its own class; pages with such links are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_url_rules": r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND f.k = 1
""",
    "op12_prefix_trie": r"""
WITH RECURSIVE bits(n, i, c) AS (
  SELECT n, 0, n FROM range(256) AS r(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8
), crc_table AS (
  SELECT list(c ORDER BY n) AS entries FROM bits WHERE i = 8
), crcs(conv_id, rest, crc) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL SELECT conv_id, substr(rest, 2), xor(entries[(xor(crc, ascii(rest)) & 255) + 1], crc >> 8) FROM crcs, crc_table WHERE rest <> ''
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM crcs WHERE rest = ''
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT c.conv_id, pos, 0 AS tail, text, id FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos, 1, text, id FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
), members AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(id, ',') OVER w AS node FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY tail, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), named AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM members
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * any_value(chars) AS saved,
    bool_and(ends) AS childless, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM named GROUP BY node
), subtrees AS (
  SELECT m.node, sum(n.saved) AS saved_tokens, count(*) FILTER (n.childless) AS n_leaves FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent
""",
    "op13_filter_audit": r"""
WITH RECURSIVE orders(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f) WHERE length(o) < 5 AND NOT contains(o, f)
), marks AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
  FROM documents
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > low THEN 'E' ELSE '' END) AS fails
  FROM texts LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails
), steps AS (
  SELECT o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, CAST(step AS INTEGER), 1) AS own, substr(o, 1, CAST(step AS INTEGER) - 1) AS before
  FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5
), judged AS (
  SELECT *, contains(fails, own) AS now, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS earlier FROM sets, steps
), told AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (now AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (now AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT earlier), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
""",
}
