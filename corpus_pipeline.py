"""The corpus pipeline: language, near-duplicates, benchmark leaks, source mixture, shards.

Every stage takes the documents that the stage before kept (or replicated) and
works on all of them. ``run`` cuts the lineage between stages with a table in
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.llm import decontamination, hilbert_shards, langid, poisson_mix, simhash
from textkiln.llm.common import cut, is_third, table

#: A document stays if its best language has at least this posterior.
LEAST_SCORE = 0.5


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language.

    Those are null, empty and letterless texts, texts of which no language is
    likely enough, and texts whose letters are far less likely than the
    predicted language's own (other languages and scripts, keyboard noise).
    Every row is judged by its text alone, so repeated rows stay or go
    together; an empty table, or one without labelled languages, gives none.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~is_third(F.col("doc_id"), 3, 1)))
    named = langid.predict(docs, model, names=("_lang_pred", "_score", "_mean", "_letters"))
    known = langid.recognised(model, F.col("_lang_pred"), F.col("_mean"), F.col("_letters"))
    return _columns(named.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE) & known), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates.

    Null and empty texts share fingerprint zero and form one group; of repeated
    rows with one id one stays. Ties, nulls and very long texts are as
    ``simhash.drop_near_duplicates`` states; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whatever its length.

    Rows are judged one by one by their whole text: null and empty texts stay,
    repeated rows stay or go together, an empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources and shuffle them.

    A null source is a source; rows without an id draw by their text; repeated
    rows get the same number of copies each; an empty table stays empty.
    """
    return _columns(poisson_mix.mix(docs, names=("_copy", "_shuffle_key")), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row on a shard and slot along a Hilbert curve.

    Null languages and sources are of class 0, null texts of the smallest size;
    ties lie by checksum and id, repeated rows get slots of their own; an empty
    table stays empty.
    """
    return hilbert_shards.assign(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
    ("sharding", shards),
]

#: SQL expresses neither the language model nor string tiling; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
