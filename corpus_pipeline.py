"""From raw documents to packed training sequences: five stages, each a table of its own.

Every stage takes and returns the columns of documents, whatever else they hold, but for the last. Rows with a null
``doc_id`` and repeated rows are documents like others, except where a stage says otherwise; a null text counts as empty;
no documents give no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import language_id, packing, quality_crf, secrets, simhash
from skyloom.llm.common import materialize, read

#: The stages are learned models and whole-text transformations, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: a null or empty text, no letters, or no language likelier than all others
    together (a tie at 0.5 stays). Without a document to learn from, all go."""
    found = language_id.identify(docs, language_id.fit(docs), keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line classifier predicts to be of low quality (a score under 0.3). Without labels all stay."""
    model = quality_crf.fit(docs, read(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, keep=docs.columns).where("predicted = 1").select(docs.columns)


#: Ids to drop that are broadcast (8 MB of ids at most); beyond, documents are joined by a shuffle.
DROPS = 1_000_000


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates. Rows of one id are one document and stay
    or go together; those without an id stay. Up to ``DROPS`` ids to drop are sent to the texts; beyond, texts and ids are
    joined by a shuffle, with the same rows."""
    drop = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    drop = materialize(drop, "dropped-ids")
    drop = F.broadcast(drop) if drop.count() <= DROPS else drop.hint("merge")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the texts; a null text stays null, and texts without secrets stay as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences; a null or empty text is its closing id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", by_language),
    ("quality_classifier", by_quality),
    ("simhash_dedup", one_of_each),
    ("secret_scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
