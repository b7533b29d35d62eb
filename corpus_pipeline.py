"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever else
they are called: operators see them under names of their own. Null texts go at the first stage (no language). Rows that repeat a
doc_id are judged each by itself until the near-duplicates, which leave one row of a doc_id; a row without a doc_id is a document
of its own, and stays there. An empty table gives no rows. Each stage is written and read back before the next, so lineage ends there; a stage's table goes once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import langid, minhash, packing, quality, secrets
from runloom.llm.shared import discard, fresh_path, read_table, stored

#: Parameters of the stages: least language score, similarity in percent, end id and tokens of a sequence.
LEAST_SCORE, PERCENT, END_ID, CAPACITY, VOCABULARY = 0.3, 80, 1, 4096, "word_bpe_49k.json"


def _apart(docs: DataFrame) -> tuple[DataFrame, str, list]:
    """``docs`` under names that no operator's columns have, the text's name there, and what gives the old names back."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    return inner, f"c{docs.columns.index('text')}", [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or whose n-grams no language's filter knows well enough."""
    model = langid.fit(docs.where(~langid.held_out()))
    inner, text, back = _apart(docs)
    return langid.predict(inner, model, text).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or that the learned decision list rejects."""
    rules = quality.learn_from(docs, read_table(spark, sf_dir, "labels"))
    inner, text, back = _apart(docs)
    return quality.judge(quality.with_statistics(inner, text), rules).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; repeated rows leave one."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), PERCENT).where("kept").select(F.col("id").alias("doc_id"))
    stays = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return stays.unionAll(docs.where(F.col("doc_id").isNull()))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is replaced by a mark; n_chars, where there is one, follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, str(public_tokenizers.path(VOCABULARY)), END_ID, CAPACITY).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and compare all documents: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        docs = stored(stage(spark, docs, sf_dir), name, "snappy", path)
        if before:  # its successor is whole
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
