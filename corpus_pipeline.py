"""A training-corpus pipeline of five stages over the table documents.

Each stage gets what its predecessor kept, as a table in the shared folder, and
judges all of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, jaccard, langid, mixing, pii
from flowloom.llm.common import held_out, numbered, stored, table
from flowloom.llm.queries import LANGUAGE_FOLDS, TARGETS, domains_of

#: Most bytes of text sent to a Python worker at a time; a task holds several copies of a batch.
BATCH_BYTES = "2m"
#: Documents whose fitted rate is below this are not drawn at all.
LEAST_RATE = 0.2

#: No SQL: language model, classifier and fitted rates cannot be stated in it.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, as stages are planned after their functions have returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those too far from all languages of the labelled rows.

    Labels in lang are not changed.
    """
    small_batches(spark)
    labelled = docs.filter(~held_out("doc_id", LANGUAGE_FOLDS))
    model = langid.train(labelled)
    limits = langid.bounds(labelled, model)
    return language_kept(docs, model, limits)


def language_kept(docs: DataFrame, model: langid.PhraseModel, limits: dict[str, langid.Bound]) -> DataFrame:
    names = ("lang_pred", "score", "bits", "letters")
    own = {c: f"__{c}" for c in names if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(own), model, bits=True).filter(langid.plausible(limits))
    return found.drop(*names).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that with the smallest id, one without an id only where no other is there."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each by its own text."""
    small_batches(spark)
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters again."""
    small_batches(spark)
    clean = pii.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the rate each document is to be drawn with; those with next to none go.

    Rates are fitted row by row, with or without an id. A column rate of the documents is replaced.
    """
    labels = domains_of(table(spark, sf_dir, "labels"))
    rows, row = numbered(docs.drop("rate"))
    rates = mixing.mix(rows, labels, TARGETS, row=row).select(row, "rate")
    return rows.join(rates.filter(F.col("rate") >= LEAST_RATE), row).drop(row)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing", mixing_rates),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep, with their rates."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs
