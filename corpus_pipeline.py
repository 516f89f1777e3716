"""A corpus pipeline: five stages over ``documents``, each an operator of ``namewright.llm``.

Each stage gets the rows that the one before it kept, written as Parquet and read again; all but the last return the columns
of documents. The stages' decisions take effect: documents that the classifier rejects go, one document of each group of near
duplicates stays, benchmark passages are cut from texts, sources are sampled or repeated to their target weights, and what is
left is written as token ids and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm import decontaminate, mixing, near_text, quality, token_store
from namewright.llm.common import DOCUMENT_COLUMNS, read
from namewright.session import cut, prepare

#: The classifier that the first stage of a run learned, by sf_dir, until the run's mix takes it.
_LEARNED: dict[str, quality.Forest] = {}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; the model learns from the labels of this run's own documents.

    Defined cases: a null text is scored as an empty one and stays null; repeated rows stay or go together; without labels all
    documents stay; an empty table gives no rows; columns other than those of documents go.
    """
    prepare(spark)
    documents = docs.select(*DOCUMENT_COLUMNS)
    model = _LEARNED[sf_dir] = quality.fitted(documents, read(spark, sf_dir, "labels"))
    return quality.score_documents(documents, model).where("quality_score >= 0.5").select(*DOCUMENT_COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by SimHash with Golay keys and an exact pass after it.

    Defined cases: those of ``near_text.keep_one_of_each_group`` (null, empty and blank texts are copies of one another; the least
    doc_id of a group stays).
    """
    prepare(spark)
    return near_text.keep_one_of_each_group(docs.select(*DOCUMENT_COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of benchmark items; a document with nothing else in it goes.

    Defined cases: those of ``decontaminate.remove_spans``; null, empty and blank texts stay as they are, repeated rows too.
    """
    prepare(spark)
    documents = docs.select(*DOCUMENT_COLUMNS).withColumn("_empty", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    cleaned = decontaminate.remove_spans(documents, read(spark, sf_dir, "benchmark"))
    return cleaned.where(F.col("_empty") | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated once for each time that the mix takes them; drawn by the classifier's score.

    The model is that of the run's first stage: it learned from the documents as they came in, wherever they were read, and hardly a
    rejected one is left here. Only where this stage runs by itself, the documents of ``sf_dir`` are learned from. Defined cases:
    those of ``mixing.mixed_documents``; without labels all documents weigh the same.
    """
    prepare(spark)
    model = _LEARNED.pop(sf_dir, None) or quality.fitted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS), model)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written in the frame format and read back: a row per document of the mix.

    Defined cases: those of ``token_store`` (a null or empty text has only the end id, repeats are documents of their own).
    """
    prepare(spark)
    return token_store.token_output(docs.select("doc_id", "text"), token_store.default_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: The classifier and the fingerprints cannot be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
