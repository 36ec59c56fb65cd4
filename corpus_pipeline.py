"""A training corpus from raw documents: five stages, each on all that the one before kept.

Every stage judges each row by its own text: rows with a null, shared or repeated doc_id are
rows like any other, and further columns of any name pass through unchanged (``shielded``
hides them from the operators).  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import decontam, lang_id, near_dedup, pii, spm_sampling
from sondeo.llm.common import filed, free_name, row_places, shielded, staged, table
from sondeo.llm.queries import SAMPLE_SEED, pii_key, piece_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier accepts.  It learns from the rows with a
    language and a doc_id that are not held out, as they come (a repeated row counts again);
    without any, nothing is accepted.  Null texts and texts without a letter go."""
    model = lang_id.fit(docs)
    return shielded(docs, lambda d: lang_id.predict(d, model).filter("accepted"), ("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least doc_id, null ids
    last, and of equal ids the first in the table's files.  So of exact copies with one id
    or without any one stays too.  Null and blank texts are no duplicates and stay."""
    docs, at = filed(docs), free_name("place", docs.columns)
    gone = near_dedup.near_duplicates(docs, percent=80).filter("not chosen").select(F.col("place").alias(at))
    rows = row_places(docs, *(F.col(f"`{c}`") for c in docs.columns), to=at)
    return rows.join(gone, at, "left_anti").drop(at)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null texts have none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data of the text replaced by format-preserving pseudonyms, the same in every
    row; null texts stay null."""
    return shielded(docs, lambda d: pii.pseudonymise(d, pii_key(spark)), ("doc_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text in ``piece_ids``, and in ``decoded`` the text that they
    give back; columns of these names are replaced.  Null texts: null in both."""
    keep = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    return shielded(docs, lambda d: spm_sampling.encode(d, piece_model(), seed=SAMPLE_SEED, decoded="decoded"), ("doc_id", "text"), add=("piece_ids", "decoded"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("sentencepiece", pieces),
]

#: The stages train a model, hash, permute and sample: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
