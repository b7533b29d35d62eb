"""Queries of the operators over their whole tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import editcount, htmltext, langid, minhash, packing, pieces, quality, secrets, tokens_io, vectors
from runloom.llm.shared import read_table, stored

#: Fixed values of the queries.
END_ID, CAPACITY, PERCENT, VOCABULARY = 1, 4096, 85, "word_bpe_49k.json"
BYTE_VOCABULARY, PIECE_VOCABULARY, SEED = "byte_bpe_50k.json", "piece_bpe_32k.model", 17


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def planned_edits(text: str = "text", key: str = "doc_id") -> Column:
    """Three edits per document, placed by hashes of its key: a deletion, a replacement and an insertion of its own text."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(key)), n + 1).cast("int")
    own = lambda k, size: F.coalesce(F.substring(F.col(text), at(k) + 1, F.lit(size)), F.lit(""))
    edit = lambda place, cut, add: F.struct(place.alias("at"), F.lit(cut).alias("cut"), add.alias("add"))
    return F.array(edit(at(1), 40, F.lit("")), edit(at(2), 9, own(5, 17)), edit(at(3), 0, own(6, 60)))


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, stored, then read again for a batch of edits."""
    import public_tokenizers

    by = vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN
    trees = stored(editcount.plant(read_table(spark, sf_dir, "documents"), *by), "trees")
    return editcount.apply_edits(trees.withColumn("edits", planned_edits(key="id")), *by, keep_trees=False).withColumnRenamed("id", "doc_id")


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens_io.write(read_table(spark, sf_dir, "documents"), vocabulary(), END_ID)
    return tokens_io.digest(spark, out).withColumnRenamed("id", "doc_id")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, digested, and whether decoding gives back the text."""
    return pieces.digest(read_table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY), SEED).withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(), END_ID, CAPACITY).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality.learn_from(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(quality.statistics(docs), rules).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_langid_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), PERCENT).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_edit_aware_counts, op2_tag_path_ratios, op3_secret_scans, op4_sorted_projections, op5_token_files, op6_quality_rules, op7_langid_filters, op8_minhash_near_dedup, op9_sampled_pieces, op10_best_fit_packing)}

ORACLE_SQL: dict[str, str] = {}
