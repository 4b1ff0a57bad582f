"""Raw documents to training tokens: each stage applies one operator to what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import line_dedup as lines
from fleetlens.llm.bpe import bpe_decode, bpe_encode
from fleetlens.llm.fm_index import contamination, without_spans
from fleetlens.llm.hyperminhash import near_duplicates
from fleetlens.llm.weak_labels import classify
from fleetlens.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars brought up to date (0 for a null text)."""
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    return df.select(*[chars.alias(c) if c == "n_chars" else c for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects, as poor or as toxic, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(classify(docs, labels).where(~F.col("rejected")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only."""
    return _documents(lines.line_dedup(docs, min_chars=20, min_docs=3))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Repeated rows of that document are one document, so one of them stays; texts
    without words have no duplicates.
    """
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"])
    return _documents(docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the documents."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(without_spans(contamination(docs, benchmark, window=10)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document; ids that don't decode to the text are an error.

    The ids are written in between, so that a core has one Python worker at a time, not an encoder's and a decoder's.
    """
    ids = staged(bpe_encode(docs, VOCABULARY, public_tokenizers.PATTERN), "ids")
    back = bpe_decode(ids, VOCABULARY)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("the ids don't decode to the text"))).alias("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Classifier, sketches and tokens are beyond SQL; tests/llm holds the brute-force comparison.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
