"""The corpus pipeline: toxicity, near duplicates, repeated strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of docs. Rules for odd rows are those of the operators: null and empty texts pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, neardup, packing, scratch, suffixdedup, toxicity
from arbora.session import ship

#: Temporary tables of the stage that ran last. Its result has to be stored, or read, before the next one begins, which deletes them.
_last: list = []


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        scratch.release(_last)
        before = set(scratch.written())
        out = function(spark, docs, sf_dir)
        _last[:] = [t for t in scratch.written() if t not in before]
        return out

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't flag."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near duplicates."""
    return neardup.keep_one_each(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that an earlier document has; documents with nothing left go."""
    return suffixdedup.cut_texts(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs: a passage stays one in a long text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of each document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: a trained model, link components, and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over sf_dir's documents; each one's result is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = list(_last)
            docs = scratch.materialise(docs)
            _last[:] = made
    return docs
