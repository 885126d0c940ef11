"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Documents that the quality classifier rejects go; one document of each group of near copies stays; contaminated
documents go; the sources are mixed by temperature; the result is written as token ids and read back. Extra columns of
any name pass through the first four stages unchanged; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.llm import decontam, minhash, mixing, quality, queries, store, tokens


def _renamed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents under names that meet no result column's, and the name of their text."""
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own["text"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts are scored as texts without a byte; without labels of both
    kinds all are kept (every score is 0.5). Rows that share a key are scored each by its own text."""
    model = quality.train(docs, store.table(spark, sf_dir, "labels"))
    rows, text = _renamed(docs)
    return quality.rate(rows, model, text=text).where("predicted = 1").select(*rows.columns).toDF(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, likeness 0.8): the least key, null least of all. Texts without a
    word are linked with nothing and stay; rows that share a key stay or go together."""
    return minhash.deduplicate(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark window. A text without words stays; an empty
    benchmark removes nothing."""
    rows, text = _renamed(docs)
    judged = decontam.decontaminate(rows, store.table(spark, sf_dir, "benchmark"), text=text)
    return judged.where(~F.col("contaminated")).select(*rows.columns).toDF(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, some not at all. A null source is a source of its own; documents
    without tokens are not drawn."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and checksum read back from the id files, in ascending order of doc_id; null texts are empty and
    hold the end id alone."""
    path = store.Scratch(spark, "corpus").path("ids")
    tokens.write(docs, path, queries.vocabulary())
    return tokens.read(spark, path)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("temperature mixing", mixed_documents),
    ("token ids", token_ids),
]

#: A learned classifier and a tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = store.Scratch(spark, "pipeline")
    docs = store.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
        store.release(spark)
    return docs
