"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratakit.llm import hnsw, jaccard, langid, lines, packing, pieces, quality, tokenfile, urls, warc
from stratakit.llm.common import read_table
from stratakit.session import ship


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokenfile.token_digests(read_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.join_components(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.piece_digests(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.predict_documents(read_table(spark, sf_dir, "documents"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return hnsw.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.95)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_columns(quality.judge(read_table(spark, sf_dir, "documents")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = read_table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.production_list(spark)).drop("in_list")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_ngram_jaccard, op3_sentencepiece, op4_language_id, op5_embedding_neardup, op6_packing, op7_warc, op8_line_dedup, op9_quality_rules, op10_url_filter)}

_HOST = "lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'))"
_PATH = "regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"


def _rule(suffix: str, prefix: str) -> str:
    return f"((host = '{suffix}' or ends_with(host, '.{suffix}')) and starts_with(path, '{prefix}'))"


_LISTED = f"regexp_matches(host, '{urls.LISTED_PATTERN}')"

ORACLE_SQL = {
    "op8_line_dedup": lines.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_url_filter": f"""
        with parts as (select page_id, coalesce({_HOST}, '') host, coalesce({_PATH}, '') path from pages)
        select page_id, host, path,
               case when {_rule("example.net", "/en/")} then 'example.net/en/' when {_rule("example.com", "/de/")} then 'example.com/de/'
                    when {_rule("org", "/fr/")} then 'org/fr/' when {_rule("net", "/")} then 'net/' end as rule,
               case when {_rule("example.net", "/en/")} then 'allow' when {_rule("example.com", "/de/")} then 'block'
                    when {_rule("org", "/fr/")} then 'allow' when {_rule("net", "/")} then 'block'
                    when {_LISTED} then 'block' else 'allow' end as verdict
        from parts""",
}
