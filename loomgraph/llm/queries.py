"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its base and model scores; null and empty texts have one token, repeated rows score alike, an empty
    table gives no rows."""
    from .lm_score import score

    return score(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its counts and verdict; null and empty texts fail, a posterior of just one half is kept, repeated
    rows are judged alike, an empty table gives no rows."""
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with a language; null texts and texts without letters are und, repeated rows are labelled alike, an empty
    table gives no rows."""
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with host, path, rule and verdict; a null url has neither host nor path, ties go to the longest rule,
    repeated rows are judged alike, an empty table gives no rows."""
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its count of ids and digests; null and empty texts have none and the digests of nothing, repeated
    rows each give a row, an empty table none."""
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the doc_id that stays; null counts as empty, repeated rows count in their group and are all kept if
    theirs is the largest doc_id, an empty table gives no rows."""
    from .exact_dedup import exact_groups

    groups = exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of documents with its place; null and empty texts are a piece of one token, repeated rows are packed each, an empty
    table gives no rows."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep_ids=False).drop("ids")


def packing_under_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7, with at most 12 documents and half the attention cost of a full sequence in each, so that all three capacities cut."""
    from .packing import Capacity, pack

    capacity = Capacity(2048, documents=12, attention=2048**2 // 2, by="dot")
    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity, keep_ids=False).drop("ids")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of documents with its score and verdict; null and empty texts have none, repeated rows are each scanned, an
    empty table gives no rows."""
    from .secret_scan import findings

    found = findings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with fingerprint and component; texts without words have fingerprint zero and are linked like any other,
    repeated rows share theirs, an empty table gives no rows."""
    from .simhash import near_groups

    groups = near_groups(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with what is removed; null and empty texts have no words, rows of one doc_id do not cover each other,
    rows without one neither cover nor are covered, an empty table gives no rows."""
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=13, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ALL = (op1_maxent_lm, op2_quality_rules, op3_language_id, op4_url_filter, op5_byte_bpe, op6_exact_dedup, op7_best_fit_packing, op8_secret_scan, op9_simhash_near_dedup, op10_substring_dedup, packing_under_capacities)

OP6_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
  FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents))
"""

OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, w[i:i + 12] AS s FROM starts),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM windows) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hits),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL}
