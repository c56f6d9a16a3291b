"""The ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontaminate, digest, langid, lines, mixing, simhash, spans, tokens, toxicity, warc
from edgeloom.llm.common import table, workdir

#: Default of the tokenizer parameter: a name of the installed public vocabularies.
TOKENIZER = "word_bpe_49k.json"


def op1_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = workdir(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path or str(public_tokenizers.path(TOKENIZER)))
    return tokens.digest(spark, path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(table(spark, sf_dir, "documents"))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_site_lines": op6_site_lines,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_quartile_digest": op10_quartile_digest,
}
