"""From raw documents to token ids: the operators of `cvegrid.llm` one after another.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.llm import bpe, jaccard, mixing, phrases, quality
from cvegrid.llm.shared import Scratch, table, whole_text

# Of the near-duplicate stage; the query op7 has its own.
SHINGLE = 5
HUNDREDTHS = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed against each other, hold for good."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five words a shingle, similarity 0.8."""
    return jaccard.one_of_each(docs, shingle=SHINGLE, hundredths=HUNDREDTHS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the phrases that also start earlier; n_chars follows the text."""
    cut = phrases.cut_phrases(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text they decode to."""
    rows = docs.withColumn("text", whole_text("text"))
    both = bpe.decode(bpe.encode(rows).drop("text"))
    return both.select("doc_id", "lang", "source", "n_chars", "ids", *bpe.digests(both))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

# Neither the fit of the rules nor the merges of tokens can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
