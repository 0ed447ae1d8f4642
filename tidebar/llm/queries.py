"""The operators' queries over the driver tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import (
    line_templates, packing, pii, quality_rules, ranked_search, secret_links, simhash, source_mix, spelling, substring_dedup, token_rollup,
    topk_search, url_rules,
)
from tidebar.llm.check_sql import SQL
from tidebar.llm.common import staged
from tidebar.session import scratch_path


def without_junk(text: bytes) -> bytes:
    return text.translate(None, b"#*$%&|<>")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def op1_line_templates(spark: SparkSession, path: str) -> DataFrame:
    out = line_templates.drop_recurring(table(spark, path, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"))


def op2_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    out = quality_rules.judge(table(spark, path, "documents"))
    return out.drop("rejected_by")


def op3_source_mix(spark: SparkSession, path: str) -> DataFrame:
    weights = source_mix.label_weights(table(spark, path, "labels"))
    return source_mix.mix(table(spark, path, "documents"), weights).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op4_topk_search(spark: SparkSession, path: str) -> DataFrame:
    vectors = table(spark, path, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op5_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, path, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Inserts all documents under every tokenizer version, deletes the toxic ones from every version, and revises each
    version's own counts of those labelled as poor to those of the text without symbols of junk; then sends a batch again
    and compacts."""
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    counts = staged(token_rollup.counted(docs, revise=without_junk), "token-counts")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = counts.join(marks, "doc_id")
    toxic = token_rollup.signed(marked.where("toxic = 1"), old=F.col("tokens"))
    poor = marked.where("quality = 0 AND NOT toxic <=> 1")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit("b1", token_rollup.signed(counts, new=F.col("tokens")))
    rollup.commit("b2", toxic)
    rollup.commit("b3", token_rollup.signed(poor, new=F.col("revised"), old=F.col("tokens")))
    rollup.commit("b2", toxic)
    rollup.compact("base-3")
    return rollup.totals()


def op7_pii(spark: SparkSession, path: str) -> DataFrame:
    return pii.report(table(spark, path, "documents"))


def op8_simhash(spark: SparkSession, path: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, path, "documents"))


def op9_url_rules(spark: SparkSession, path: str) -> DataFrame:
    """Labelled are the pages that a given rule judges, bad if it blocks them: what their urls have in common is mined and
    judges the pages that no given rule fits."""
    pages = table(spark, path, "pages").select("page_id", "url")
    name, verdict = url_rules.given_rule(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")), url_rules.GIVEN)
    labelled = pages.where(name.isNotNull()).select("url", (verdict == "block").alias("bad"))
    return url_rules.judge(pages, labelled)


def op10_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(table(spark, path, "documents"))


def op11_secret_links(spark: SparkSession, path: str) -> DataFrame:
    return secret_links.report(table(spark, path, "documents"))


def op12_spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    return spelling.variants(table(spark, path, "documents"))


def op13_ranked_search(spark: SparkSession, path: str) -> DataFrame:
    return ranked_search.search(table(spark, path, "documents"), table(spark, path, "benchmark"))


ALL = (
    op1_line_templates, op2_quality_rules, op3_source_mix, op4_topk_search, op5_substring_dedup, op6_token_rollup,
    op7_pii, op8_simhash, op9_url_rules, op10_packing, op11_secret_links, op12_spelling_variants, op13_ranked_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return SQL
