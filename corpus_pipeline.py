"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents. Defined cases are those of the operators; a document whose lines all lie in others stays with an
empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, documents
from scorelake.llm.decontaminate import decontaminate
from scorelake.llm.line_dedup import line_dedup
from scorelake.llm.ngram_join import near_duplicates
from scorelake.llm.packing import pack
from scorelake.llm.quality import quality_scores, train
from scorelake.llm.queries import bpe_pattern, vocabulary


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs in which columns other than doc_id and text have names that no operator uses, and the names they had."""
    had = {c if c in ("doc_id", "text") else f"__column_{i}": c for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(old).alias(new) for new, old in had.items())), had


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named, had = plain_names(docs)
    return quality_scores(named, model).where("predicted = 1").select(*(F.col(new).alias(old) for new, old in had.items()))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    named, had = plain_names(docs)
    kept = line_dedup(named)
    return kept.select(*(F.char_length("text").cast("long").alias(old) if old == "n_chars" else F.col(new).alias(old) for new, old in had.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays, with all rows of that id; rows without an id stay."""
    found = near_duplicates(docs)
    gone = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), bpe_pattern())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Fitting a model, components and packing are beyond SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
