"""The queries of this folder's operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.ship import ship

Query = Callable[[SparkSession, str], DataFrame]
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.chat import chat_digests

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(given.unionByName(extra))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.urlfilter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.webp import media, media_digests

    return media_digests(media(table(spark, sf_dir, "documents")))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.pfair import mix_places

    return mix_places(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lsh import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_shard_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (op1_chat_format, op2_url_filters, op3_media_webp, op4_pfair_mix, op5_toxicity, op6_byte_bpe, op7_quality_fm, op8_embedding_lsh, op9_ngram_jaccard, op10_shard_propagation)
    return {f.__name__: f for f in every}


_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')"""

OP1_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length('<|im_start|>') + length({_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + 1
             + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS formatted_chars
  FROM given GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (VALUES {_RULES}), fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, parts.host, parts.path, fits.rule, coalesce(fits.v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND fits.n = 1
"""


OP8_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, len(embedding) AS size, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, label, size, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM good
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.label = b.label AND a.size = b.size AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.93
), reach(u, v) AS (
  SELECT u, v FROM pairs UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
), low AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.u LEFT JOIN n ON vec_id = n.u WHERE vec_id IS NOT NULL
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT u, v FROM pairs UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
), low AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN low ON doc_id = u
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_url_filters": OP2_SQL, "op8_embedding_lsh": OP8_SQL, "op9_ngram_jaccard": OP9_SQL}
