"""From raw documents to encoded training data: toxicity, near copies, personal data, source mix, tokens.

``STAGES`` are applied in order to ``documents``; the result of each is written as Parquet in the shared folder and read
again as the next one's input. Null texts, repeated rows, empty tables and further columns pass as each stage's operator
states; columns besides those of ``documents`` are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import bpe, minhash, mixture, pii, toxicity
from tastegrid.llm.common import bounded_batches, documents, keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones of ``docs``, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicate(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each piece of personal data in its place."""
    return _as_documents(pii.redact(pii.find(docs.select(*COLUMNS))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights: texts as far and as often as their source's blocks are taken."""
    return _as_documents(mixture.mixed_rows(mixture.mix(docs.select(*COLUMNS))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the ids' decoding."""
    return bpe.encode(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("token_ids").cast("long"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _bounded(drop_toxic)),
    ("near_duplicates", _bounded(drop_near_copies)),
    ("personal_data", _bounded(redact_personal_data)),
    ("source_mix", _bounded(mix_sources)),
    ("tokens", _bounded(encode)),
]

#: The stages are trained models, hashing and tokenizing; no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
