"""A training corpus from ``documents``: rules, lines, near copies, benchmark passages, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows of its input; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.decontamination import remove_contamination
from loomtext.llm.document_queries import PIECES
from loomtext.llm.line_dedup import drop_repeated_lines
from loomtext.llm.merge_pieces import encode_pieces
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.quality import judge_quality
from loomtext.scratch import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no Jensen-Shannon verdicts, line runs or piece merges; tests compare stages by brute force.
ORACLE_SQL = None


def _changed(rows: DataFrame, changed: str) -> DataFrame:
    """Rows with their remaining text and its length; texts of which no word is left go."""
    gone = (F.col(changed) > 0) & (F.regexp_replace("remaining", r"\s+", "") == "")
    return rows.where(~gone).select(
        "doc_id",
        F.col("remaining").alias("text"),
        "lang",
        "source",
        F.when(F.col(changed) > 0, F.length("remaining").cast("long"))
        .otherwise(F.col("n_chars"))
        .alias("n_chars"),
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return judge_quality(docs, source="source", keep=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing else is left."""
    return _changed(drop_repeated_lines(docs, keep=COLUMNS), "n_deleted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least id, then of the least text hash. Of rows
    that are equal in both one stays; only those are moved for it. Texts without a word are in no group and stay."""
    found = near_duplicates(docs, keep=COLUMNS).where("leads")
    repeated = (F.col("copies") > 1) & (F.col("n_shingles") > 0)
    single = found.where(~repeated).select(*COLUMNS)
    # Rows that lead have one id and text in a component, and so do components that share them.
    one = found.where(repeated).dropDuplicates(["doc_id", "text"])
    return single.unionByName(one.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, and documents of which nothing else is left go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _changed(remove_contamination(docs, benchmark, keep=COLUMNS), "n_removed")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, with whether decoding gives the text back."""
    encoded = encode_pieces(docs, PIECES, keep=["doc_id"], dropout=0.1, seed=1)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
