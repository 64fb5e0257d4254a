"""The subpackage's named queries, over whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpus_pipeline import END_ID, tokenizer_path
from socialspark.llm import decontaminate, exact_dedup, filter_audit, html_extract, minhash_dedup, pii, quality_qda, source_mix, suffix_dedup, token_output, url_trust, warc, whitening
from socialspark.sources.tables import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", corpus_pipeline.BATCH_BYTES)
    return token_output.digest_table(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_qda.fit(docs, table(spark, sf_dir, "labels"))
    return quality_qda.scores(docs.select("doc_id", "text"), model).select("doc_id", quality_qda.held_out().alias("held_out"), "score", "predicted")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("begins", "ends")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.response_records(table(spark, sf_dir, "pages"))).drop("record")


def op8_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op1_decontaminate": decontaminate.SQL, "op5_exact_dedup": exact_dedup.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op7_warc_derivatives": warc.SQL, "op9_minhash_near_dedup": minhash_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op13_pii": pii.SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
