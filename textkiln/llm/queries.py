"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.functions.hashing import seeded_u32
from textkiln.llm import chat_snapshots, decontamination, hard_negatives, hilbert_shards, langid, license_scan, merkle_audit, merkle_manifest, poisson_mix, quality_classifier, repetition, simhash, toxicity
from textkiln.llm.common import cut, in_order, is_third, running_totals, table


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the maximal conversations."""
    return chat_snapshots.collapse(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "pos", "n_turns", "rendered")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with the share of the item's words that tiles cover."""
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_words", F.size("tiles").alias("n_tiles"), F.round(F.col("covered") / F.col("item_words"), 4).alias("coverage"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a derived tree: source, then runs of 5,000 and of 500 ids.

    In every run of 500 ids one document of each source is that directory's
    LICENSE; in every tenth run it is the LICENSE of the directory above.
    """
    run, top = F.floor(F.col("doc_id") / 500), F.floor(F.col("doc_id") / 5000)
    above = F.concat_ws("/", "source", F.concat(F.lit("p"), top))
    here = F.concat_ws("/", above, F.concat(F.lit("d"), run))
    licence = F.floor(F.col("doc_id") / 20) % 25 == 0
    path = F.when(licence & (run % 10 == 0), F.concat(above, F.lit("/LICENSE"))).when(licence, F.concat(here, F.lit("/LICENSE")))
    return docs.select("doc_id", path.otherwise(F.concat(here, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited."""
    return license_scan.scan(document_files(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, repetition and verdict of every document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words"]
    return repetition.judge(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of every document in the mixture, with their shuffle keys."""
    return poisson_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key")


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along the curve."""
    return hilbert_shards.shard_rows(table(spark, sf_dir, "documents"))


def page_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages as WARC records, one archive a host, in the order of page_id.

    In the second replica some records have another first character and some
    are lost, as hashed from the page's id.
    """
    damage = seeded_u32("damage", F.col("page_id"))
    good = merkle_audit.warc_record(F.col("url"), F.col("html"))
    bad = merkle_audit.warc_record(F.col("url"), F.concat(F.lit("~"), F.expr("substring(html, 2)")))
    records = pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("archive"),
        "page_id",
        F.octet_length(good).cast("long").alias("length"),
        F.sha2(good, 256).alias("digest_a"),
        F.when(damage % 131 != 1, F.when(damage % 97 == 0, F.sha2(bad, 256)).otherwise(F.sha2(good, 256))).alias("digest_b"),
    )
    ordered = in_order(records, [F.col("archive"), F.col("page_id"), F.col("digest_a")], "warc-records")
    placed = cut(running_totals(ordered, ["archive"], {"end": F.col("length")}), "warc-offsets")
    one = placed.select("archive", (F.col("end") - F.col("length")).alias("offset"), "length", F.col("page_id").alias("record_id"), "digest_a", "digest_b")
    return one.withColumnRenamed("digest_a", "digest"), one.where("digest_b is not null").withColumnRenamed("digest_b", "digest")


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which a damaged replica of the pages differs."""
    first, second = page_replicas(table(spark, sf_dir, "pages"))
    return merkle_audit.audit(first, second)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) and positive among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), hard_negatives.quantise(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document; a third of the texts are tampered with by lower-casing A-Z."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", letters, letters.lower())
    return merkle_manifest.verify_documents(table(spark, sf_dir, "documents"), is_third(F.col("doc_id"), 3, 0), lowered)


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
