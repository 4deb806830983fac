"""Corpus pipeline: each stage calls one training-data operator on all that its predecessor kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of
``documents``. SQL can't express language models or SimHash trees, so there is
no ORACLE_SQL; the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cauldron.llm import langid, mixing, packing, simhash, substring
from cauldron.llm.columnar import stage
from cauldron.llm.queries import tokenizer_path
from cauldron.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the filters can tell; ``lang`` stays as given.

    Rejected: text that is null or has no letter (``und``), and text of whose
    n-grams the best language explains less than half the share that the
    lowest hundredth of the labelled rows reaches (other languages, random letters).
    """
    labelled = docs.where(~langid.held_out())
    filters = langid.fit(labelled)
    return langid.keep_identified(docs, filters, langid.least_share(labelled, filters))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each SimHash component; of repeated rows with that id, one."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row; passages of 20 words or more that occur earlier are cut from ``text``, ``n_chars`` follows."""
    return substring.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each run of words that a pass draws from a document, in shards."""
    return mixing.mixture(docs, share=1.5, weights=(3, 1, 2), repeats=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), length=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; the stages in between are written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
