"""The ``op<N>_<name>`` queries over the table documents, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, debruijn, decontam, golay, importance, mixing, pii, png, repeats, resharding, tokens, toxicity, url_rules
from .base import table


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=200).drop("kept")


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("row.doc_id", "held_out", "score", "predicted")


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op4_separator_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeated_spans(table(spark, sf_dir, "documents"), window=20).drop("kept")


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op8_edit_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From twelve old shards (by a hash of the text) to sixteen of equal bytes."""
    found = resharding.resharded(table(spark, sf_dir, "documents"), shards=16, columns=["doc_id"], old_shards=12)
    return found.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png.features(png.stored(table(spark, sf_dir, "documents")))


def op11_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judged(table(spark, sf_dir, "pages"), columns=["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "pattern", "verdict")


def op12_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audited(rows, conversations.damaged(rows))


def op13_sort_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_repeats": op1_suffix_repeats,
        "op2_weak_toxicity": op2_weak_toxicity,
        "op3_golay_simhash": op3_golay_simhash,
        "op4_separator_tokens": op4_separator_tokens,
        "op5_debruijn_spans": op5_debruijn_spans,
        "op6_systematic_mix": op6_systematic_mix,
        "op7_boosted_pii": op7_boosted_pii,
        "op8_edit_decontam": op8_edit_decontam,
        "op9_flow_reshard": op9_flow_reshard,
        "op10_png_media": op10_png_media,
        "op11_token_rules": op11_token_rules,
        "op12_tight_arcs": op12_tight_arcs,
        "op13_sort_count": op13_sort_count,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_systematic_mix": mixing.ORACLE_SQL,
        "op11_token_rules": url_rules.ORACLE_SQL,
        "op12_tight_arcs": conversations.ORACLE_SQL,
        "op13_sort_count": importance.ORACLE_SQL,
    }
