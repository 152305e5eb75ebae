"""The corpus pipeline: quality rules, near-duplicate removal, personal data, source mix, token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbands.llm import bpe, mixing, ngram_join, pii, quality
from riskbands.llm.common import delete, discard, left, left_by, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_OWN: dict[str, list[str]] = {}  # what the stages of an application wrote for themselves


def after_the_last(stage: Stage) -> Stage:
    """The stage, once what the stage before it wrote for itself is gone.

    Its ``docs`` are stored rows, so the former stage's result has been written in full; folders that ``docs`` itself
    reads stay, and those among them that no stage wrote are never removed here.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own, still = _OWN.setdefault(spark.sparkContext.applicationId, []), left_by(spark, docs)
        delete(spark, [p for p in left(spark) if p in own and p not in still])
        read = [p for p in own if p in still]
        before = set(left(spark))
        out = stage(spark, docs, sf_dir)
        own[:] = [*read, *[p for p in left(spark) if p not in before]]
        return out
    return run


@after_the_last
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


@after_the_last
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares enough of its five-word shingles."""
    return ngram_join.one_of_each(docs)


@after_the_last
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


@after_the_last
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


@after_the_last
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids (packed little-endian 32-bit), the slices' byte offsets and the number of ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, keep=("doc_id", "lang", "source"))
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL can't express the segment model and the encoding; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and reread by the next.

    What the stages write for themselves goes when the next one starts, and all of it if one fails; the result reads
    the last written rows.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for n, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if n < len(STAGES) - 1:
                former, docs = docs, written(out, f"pipeline-{n}")
                discard(former)
        kept.append(docs)
    return out
