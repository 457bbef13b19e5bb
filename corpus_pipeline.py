"""A corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before it left. All but the last return the columns of documents; the last
returns these too, the text cut to what is taken of it, and how a document is
taken (epoch, epochs, n_tokens, tokens_taken).

Scratch tables of a stage go when the next one begins, as its result is written
by then; a stage's own table goes when the next one's is written. What the last
result reads, the table before it and its scratch, stays in the shared folder.

Defined results. Nulls: a null or blank text is rejected by the first stage;
rows with a null doc_id pass the three stages that compare documents; a null
source is mixed as "(none)". Very long texts go through whole. Rows that repeat
doc_id and text become one; different texts of one doc_id are different documents
but for benchmark leaks, where all rows of a doc_id go with one of them. Ties are
broken as the operators state. Empty tables give empty results at every stage.
Extra columns are kept, also under names that the operators use inside; the last
stage replaces those named epoch, epochs, n_tokens and tokens_taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import decontamination, mixing, quality_rules, simhash, suffix_dedup
from latticework.session import delete, gathering, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that break the rules; documents that lose too much go."""
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash.apply(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that occur before; documents that are left empty go."""
    return suffix_dedup.apply(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same budget of tokens; texts are cut to what is taken."""
    return mixing.apply(docs)


#: By application, the scratch tables of the stage that ran last.
_left: dict[str, list[str]] = {}


def _fresh(stage):
    """A stage that first drops the scratch tables of the one before it, and no others."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        delete(spark, _left.pop(app, []))
        with gathering() as made:
            out = stage(spark, docs, sf_dir)
        _left[app] = made
        return out

    return run


STAGES = [
    ("quality rules", _fresh(quality)),
    ("near duplicates", _fresh(near_duplicates)),
    ("repeated passages", _fresh(passages)),
    ("benchmark leaks", _fresh(leaks)),
    ("mixing", _fresh(mix)),
]

#: SimHash and the randomised SVD cannot be written in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    _left.pop(spark.sparkContext.applicationId, None)  # an earlier result may still be read from these
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "pipeline")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        delete(spark, before)
        before = [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.pop(spark.sparkContext.applicationId, None)
    return out
