"""A training-data pipeline over documents: each stage takes the documents that the one
before it kept, as a table, and calls one operator of tessella.llm.

``run`` writes each stage's rows as Parquet in the shared folder and reads them again
as the next stage's documents. The last stage returns the packed pieces.

In every stage a null text is an empty one and is no error, an empty table gives an empty
result, a text of any length is read whole, and columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, near_dup, ngram_lm, packing, pii
from tessella.llm.common import read, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty ones stay; repeated rows of one id, text
    and language are judged alike; without labels nothing goes."""
    return ngram_lm.accepted(docs, ngram_lm.trusted_ids(read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the least id stays, once; texts without
    words are copies of each other."""
    return near_dup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; a null text stays null, repeated rows stay."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or the words of them with their white space, as often as the mix takes
    them. Texts without words are not taken; repeated rows count each."""
    mixed = mixing.mixed_texts(docs, mixing.plan(docs))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token streams in windows; an empty text is its end id."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Perplexities, a CRF's spans, signatures and tokenizers are no SQL: the stages are
#: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = table(stage(spark, docs, sf_dir))
        release(docs)  # the tables of the stages; the input is none
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
