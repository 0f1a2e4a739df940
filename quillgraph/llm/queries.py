"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op9_mix, oracles
from .op10_winnow import mark_contaminated
from .op11_spelling import variants
from .op12_merkle import manifest
from .op13_toxicity import score_toxicity
from .op1_substrings import remove_repeated_substrings
from .op2_windows import remove_repeated_windows
from .op3_minhash import near_duplicates
from .op4_quality import score_quality
from .op5_graph import nearest
from .op6_tokens import token_rows
from .op7_urls import filter_urls
from .op8_pii import find_personal
from .shared import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_substrings(table(spark, sf_dir, "documents"))


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mix.choose(op9_mix.counted(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_window_dedup": op2_window_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_nearest": op5_nearest,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_personal_data": op8_personal_data,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_toxicity": op13_toxicity,
}

#: Trained models, approximate search and tokenizers have no SQL.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op2_window_dedup": oracles.OP2,
    "op3_near_duplicates": oracles.OP3,
    "op9_mix_sources": op9_mix.oracle(),
    "op10_decontaminate": oracles.OP10,
    "op11_spelling_variants": oracles.OP11,
    "op12_merkle_manifest": oracles.OP12,
}
