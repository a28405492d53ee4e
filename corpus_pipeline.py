"""The corpus pipeline: language ID, near-duplicates, personal data, source mixing and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again, so a lost executor costs only the work of its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, mixing, near_dedup, packing, pii
from quillon.llm.common import documents, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) or of unsure language; lang becomes the prediction.

    Unsure is a score below what all but one in a thousand of the language's labelled documents reach. Where nothing of a
    predicted language is labelled, its documents stay.
    """
    found = materialise(language_id.identify(docs, keep=COLUMNS), "languages")
    least = F.broadcast(language_id.least_scores(found))  # a row for each learned language
    told = found.where(F.col("lang_pred") != language_id.UNDETERMINED).join(least, "lang_pred", "left")
    sure = told.where(F.col("score") * 1000 >= F.coalesce("least", F.lit(0)))
    return sure.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates (five-word shingles, similarity 0.8): that of least doc_id.

    Where ids are null or repeated, rows are told apart by a number of their own, and of a group the row of least id,
    nulls last, then of least number stays. So a row of a null id goes only if it is a copy.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.where("count > 1 or doc_id is null").isEmpty():
        kept = near_dedup.near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
        return docs.join(materialise(kept, "kept").hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows, width=5, percent=80, id_col="row").select("row", "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    kept = materialise(groups.groupBy("component_id").agg(F.min(first).alias("first")).select("first.row"), "kept")
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select(*COLUMNS)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind; all documents stay. n_chars is that of the new text."""
    return pii.scan(docs, keep=COLUMNS, redact=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by the Poisson counts of their sources, in a hashed global order."""
    return mixing.replicate(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, ids=True)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", private_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Networks, MinHash and column generation have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
