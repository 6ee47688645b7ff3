"""A training corpus from raw documents: five stages, each over all the last one kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which ``run`` writes to the
shared folder and reads again for the next.  All but the last keep the columns of
``documents``: ``doc_id, text, lang, source, n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.llm import encoding, langid, lines, mixing, simhash
from cellfold.runtime import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is taken for certain from this score on.
CERTAIN = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language, named by the network; texts without a letter or of no
    certain language go."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for a word, go; documents left without a word go."""
    cut = lines.dedup_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each piece of a document that a slot takes."""
    return mixing.mixed_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every piece, and whether they decode to its very bytes."""
    vocabulary = encoding.multilingual()
    texts = docs.select("doc_id", "lang", "source", "n_chars", "text", F.sha2(F.coalesce(F.encode("text", "utf-8"), F.lit(b"")), 256).alias("_sha"))
    found = encoding.encode(texts, vocabulary, decoded=True)
    same = F.sha2("decoded", 256) == F.col("_sha")
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL has no network and no tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
