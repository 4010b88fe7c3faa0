"""From raw documents to packed training sequences: five stages, each a DataFrame of what it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup as lines
from quarry.llm import mixing, packing, quality, simhash
from quarry.llm.common import materialize, pick
from quarry.llm.queries import vocabulary

VOCABULARY = "word_bpe_49k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of the mix. The budget asks for just as many clean tokens as there are, and nothing is repeated, so what goes is junk and toxic.
SHARES = {"clean": 0.96, "junk": 0.03, "toxic": 0.01}


def _of_rows(docs: DataFrame, chosen: DataFrame, *names: str) -> DataFrame:
    """The rows of docs that chosen names by these columns (and text_hash for the text), nulls being equal.

    A decision of a stage hangs on a row's text and source only, so rows that repeat a doc_id, or have none, are
    each decided by their own.
    """
    keyed = pick(docs, **{c: c for c in COLUMNS}).withColumn("text_hash", F.xxhash64("text"))
    named = chosen.select(*[F.col(n).alias(f"_{n}") for n in names]).distinct()
    same = F.lit(True)
    for n in names:
        same = same & keyed[n].eqNullSafe(named[f"_{n}"])
    return keyed.join(named, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the rules and whose host does."""
    kept = quality.quality_rules(docs).where("kept").withColumnRenamed("host", "source")
    return _of_rows(docs, kept, "doc_id", "text_hash", "source").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines that other documents keep; n_chars follows the text.

    That holds for documents that are mostly such lines too; the first occurrence of each line stays.
    """
    out = lines.line_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id, then text hash, then other columns; null ids come last.

    Rows link when their five-word shingles have a similarity of 0.8 or more; SimHash finds the candidates.
    """
    kept = _of_rows(docs, simhash.near_duplicate_texts(docs).where("kept"), "doc_id", "text_hash")
    one = kept.groupBy("doc_id", "text_hash").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("x"))
    return one.select("doc_id", "x.text", "x.lang", "x.source", "x.n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rates keep. No rate is above 1, so each stays once or goes."""
    rates = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES, vocabulary(VOCABULARY), budget="clean", most=1.0)
    return _of_rows(docs, materialize(rates.where("copies >= 1").select("doc_id", "text_hash"), "mix-kept"), "doc_id", "text_hash").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.packed_documents(docs, vocabulary(VOCABULARY), end_id=1)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup), ("mixing", mix), ("best-fit packing", pack)]
#: Encoding, learning and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
