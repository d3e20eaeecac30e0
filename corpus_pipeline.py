"""Corpus pipeline: quality classifier, line dedup, near duplicates, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents.

Defined cases: columns of docs beyond those of documents are not read and not returned, so none can clash; an empty table gives an empty
result in every stage. A null text counts as empty for the classifier, the n-gram join and packing, and stays null through line dedup and redaction,
where there is nothing to take out; its n_chars is null. Null and repeated ids are kept: rows are told apart by file and place, each is scored, cleaned and
packed for itself, and of a near-duplicate class the row with the least id, file and place stays (rows with null ids last). Texts of any length go whole through every stage. A document
without words is a class of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import table, written
from terravane.llm.line_dedup import line_dedup
from terravane.llm.ngram_join import near_duplicates
from terravane.llm.packing import pack
from terravane.llm.quality_cnn import THRESHOLD, scored, train
from terravane.llm.secret_crf import redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to this number in all are broadcast when a stage drops rows; beyond it the join shuffles.
BROADCAST_IDS = 200_000


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels outside the held-out fold, accepts."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored_rows(docs, model).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def scored_rows(docs: DataFrame, model) -> DataFrame:
    """docs with the score beside each row: rows go through the scan whole, so no join can mix up repeated ids."""
    packed = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return scored(packed, model, "row", "text").select("doc_id.*", "score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines."""
    return _as_documents(line_dedup(docs.select(*COLUMNS)))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with a unique, stable _key of each row that sorts by doc_id: its id, file and place in the file."""
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        placed = docs.select(*COLUMNS, *place)
    except AnalysisException:  # not a plain scan of files
        placed = written(docs.select(*COLUMNS), "rows").select(*COLUMNS, *place)
    return placed.select(*COLUMNS, F.struct("doc_id", "_file", "_at").alias("_key"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    rows = keyed(docs)
    classes = near_duplicates(rows, "_key")
    gone = written(classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone")), "gone")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, F.col("_key") == F.col("_gone"), "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return _as_documents(redacted(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: The classifier and the tagger are learned models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
