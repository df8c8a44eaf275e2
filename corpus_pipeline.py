"""The corpus pipeline: documents through five of the training-data operators, each stage on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of ``documents`` for all but the last;
``run`` writes each result and reads it again for the next stage, then deletes the one before.

Null and empty texts, ties, repeated rows and columns beyond those of ``documents`` (also with names that an operator uses) are
taken by every stage as its docstring says; an empty table goes through all stages empty. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import quality
from registra.llm.common import remove_table, shared_folder, table
from registra.llm.decontam import without_contaminated
from registra.llm.lines import texts_without_repeats
from registra.llm.pieces import encode
from registra.llm.simhash import one_of_each_group


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents of ``sf_dir`` that are not held out.

    Null and empty texts are scored as texts without words and go or stay by that score; repeated rows get the same score.
    """
    return quality.accepted(docs, quality.trained_on(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts, and n_chars follows; every row stays, also one whose text is null or all gone.

    Rows that are equal in doc_id and text are one document and keep the same lines.
    """
    return texts_without_repeats(docs, size="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id; another text under the same doc_id is a row of its own.

    Null and empty texts are one group; of rows that are equal in doc_id and text one stays.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item go; null and empty texts have no window and stay, repeated rows go together."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as piece ids; null and empty texts have none, every row stays."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), digest=True)
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_pieces"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokenize),
]

#: SQL can express neither the trained classifier nor the piece segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor kept; the last one is returned unwritten, over the table of the stage before."""
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if old:
            remove_table(docs, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
