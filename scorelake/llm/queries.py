"""The queries opN_<name> of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, file_place
from . import license_scan as licences
from .decontaminate import contaminated
from .license_scan import license_scan
from .line_dedup import line_dedup
from .media import media_columns
from .ngram_join import near_duplicates
from .packing import pack
from .pii import BASE, find_pii, listed
from .quality import held_out, quality_scores, train
from .sharding import reshard
from .token_count import token_counts


def vocabulary(name: str) -> str:
    """A public vocabulary file: in SCORELAKE_TOKENIZERS where that is set, else where the installed package has it."""
    if folder := os.environ.get("SCORELAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "share", "first_block", "last_block")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("__place", file_place())
    return pack(docs, vocabulary("byte_bpe_50k.json"), bpe_pattern(), salt_col="__place")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout before: one file for each of 16 groups of sources, so a hot source makes one shard far too large."""
    before = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "utf-8")), F.lit(16))
    docs = documents(spark, sf_dir).withColumn("__place", file_place())
    out = reshard(docs, before, 16, salt=F.col("__place"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_media_columns, op4_line_dedup, op5_packing, op6_ngram_join, op7_quality, op8_pii, op9_decontamination, op10_sharding)}


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
),
keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: Every pair of documents that share a shingle, then reachability by recursion.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.shingles)
"""

#: Every window of every document against every item that it shares a shingle with.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dp AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS parts, len(w) AS n FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS own, len(w) AS m FROM b WHERE len(w) >= 5),
pairs AS (SELECT DISTINCT x.doc_id, y.item_id FROM (SELECT doc_id, unnest(list_distinct(parts)) AS p FROM dp) x JOIN (SELECT item_id, unnest(own) AS p FROM bp) y USING (p)),
windows AS (
  SELECT doc_id, item_id, own, list_distinct(parts[i : i + m - 5]) AS part FROM (
    SELECT doc_id, item_id, own, m, parts, unnest(range(1, greatest(n - m, 0) + 2)) AS i FROM pairs JOIN dp USING (doc_id) JOIN bp USING (item_id))
),
sizes AS (SELECT doc_id, item_id, length(array_to_string(list_intersect(part, own), '')) AS held, length(array_to_string(part, '')) + length(array_to_string(own, '')) AS total FROM windows)
SELECT doc_id, item_id, max(held / (total - held)) AS similarity FROM sizes WHERE 100 * held >= 80 * (total - held) GROUP BY doc_id, item_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": OP6_SQL, "op9_decontamination": OP9_SQL, "op1_license_scan": licences.oracle_sql(), "op4_line_dedup": OP4_SQL}
