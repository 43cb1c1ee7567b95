"""From raw documents to token ids, in five stages. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goalweave.llm import common, op1_mixing, op3_pieces, op7_lines, op8_minhash, op10_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Characters from which equal lines go and edits of the line stage, as in op7_lines.
SHORTEST, EDITS = 1, 4
#: Words and percent of the near-duplicate stage; weights, share and copies of the mix; the model of the last stage.
WIDTH, PERCENT = 5, 80
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return op10_quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that equal an earlier one or are within up to four edits of it; n_chars is counted anew."""
    return op7_lines.without_repeated_lines(docs, equal=SHORTEST, edits=EDITS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return op8_minhash.kept_documents(docs, WIDTH, PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return op1_mixing.mixture(docs, WEIGHTS, SHARE, CAP)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, decoded (the text the ids give) and n_tokens."""
    coded = op3_pieces.round_trips(docs, public_tokenizers.path(MODEL), ["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: Neither the classifier nor the entropy balance nor the encoding can be put in SQL; tests/llm hold the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
