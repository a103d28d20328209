"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import digests, encode
from .chat import format_chats, read_back
from .common import table
from .exact_dedup import exact_duplicates
from .fill_middle import digests as middle_digests
from .fill_middle import fill_in_middle
from .licenses import findings as licenses
from .mixing import taken
from .packing import pack
from .periodic import findings as run_findings
from .periodic import periodic_runs, planted
from .secrets import findings
from .sharding import byte_shards
from .simhash import near_duplicates
from .toxicity import toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(turns))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = byte_shards(table(spark, sf_dir, "documents"), 40)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_findings(periodic_runs(planted(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_best_fit_packing, op3_byte_bpe, op4_licenses, op5_toxicity, op6_chat_format, op7_nearest, op8_secrets, op9_exact_dedup, op10_sharding, op11_mixing, op12_fill_in_middle, op13_periodic_runs)}

ORACLES = {
    "op9_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY text)
    """,
    # the closed form of the same mix: each source's shuffled stream up to its target, from the beginning again where it ends
    "op11_mixing": """
        WITH docs AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   substr(sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents
        ), sized AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM docs GROUP BY source
        ), weighed AS (
            SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap, (SELECT sum(source_size) FROM sized) AS whole FROM sized
        ), filled AS (
            SELECT *, CAST(cap AS DOUBLE) / weight AS full_at,
                   (1.5::DOUBLE * whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, n)
        ), water AS (SELECT min_by(level, full_at) AS level FROM filled WHERE full_at > level),
        targets AS (
            SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * water.level), CAST(cap AS DOUBLE)) AS target FROM weighed, water
        ), placed AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS stop,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS place
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(place + size, stop) - place) + greatest(0, least(place + source_size + size, stop) - place - source_size) AS BIGINT) AS taken
        FROM placed
    """,
    "op12_fill_in_middle": """
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), chosen AS (
            SELECT *, len(tokens) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
                   CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM cut
        ), placed AS (
            SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM chosen
        ), parts AS (
            SELECT *, coalesce(array_to_string(tokens[:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix FROM placed
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
