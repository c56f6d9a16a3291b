"""Corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontaminate, mixing, simhash, tokens, toxicity
from edgeloom.llm.common import table, workdir
from edgeloom.llm.queries import TOKENIZER

#: What a Python worker remembers of words: executors that have run other stages have little memory left.
MEMO_BYTES = 24 << 20


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), memo_bytes=MEMO_BYTES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are alike by four fifths or more."""
    return simhash.dedup(docs, shingle=5, similar=True)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item (the threshold of two is op4's column's alone)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.take(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token files; return what they hold, a row a document."""
    import public_tokenizers

    path = workdir(spark, "tokens")
    tokens.write_tokens(docs, path, str(public_tokenizers.path(TOKENIZER)), memo_bytes=MEMO_BYTES, chunk_bytes=1 << 20)
    return tokens.digest(spark, path)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("token_output", token_output),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the whole of ``documents``, through a written table after each but the last."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = workdir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
