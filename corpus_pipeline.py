"""A corpus pipeline of five stages, each on all that the one before it kept.

Quality rules, quality classifier, near duplicates, personal data, packing. Every stage takes ``(spark, docs, sf_dir)``; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import ngram_join, packing, pii, quality_crf, quality_rules
from pathloom.llm.common import drop_path, labelled_sample, shared_table, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the base rule or the loss of text rejects."""
    return _counted(quality_rules.clean(docs))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go. It is fitted on labelled rows of the whole table, as few bad ones are left here."""
    net = quality_crf.fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", quality_crf.SAMPLE))
    return quality_crf.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays."""
    return ngram_join.deduplicate(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds."""
    return _counted(pii.redact_all(docs, pii.fit(pii.surroundings(docs))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 2048 tokens."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = shared_table(stage(spark, docs, sf_dir), name)
        if before:  # nothing reads the stage before any more
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and the packing search have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
