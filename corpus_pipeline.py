"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import decontaminate, langid, packing, pii, simhash
from murmuration.llm._common import TEXT_ROWS, located, private, table, without, work_dir, written
from murmuration.llm.queries import tokenizer


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns c0, c1, ..., which no operator's own columns can clash with, and what each is called there."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {name: f"c{i}" for i, name in reversed(list(enumerate(docs.columns)))}


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after TEXT_ROWS is set as the most rows that pass to Python at a time: the caller writes what it returns, whole texts or token ids, and an executor's limit holds for all tasks' batches, on both sides, together."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
            spark.conf.set(key, TEXT_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents whose text is null, empty or without any letter. Stays: the rest; lang becomes the predicted language where it was null.

    Ties between languages go to the first by name. Very long texts are read whole. Equal rows are judged each. Columns
    named like the model's own come through unchanged. Where no row has a language, lang stays null. Empty table: empty.
    """
    rows, at = _numbered(docs)
    profiles = langid.learn(rows.where(~langid.held_out(at["doc_id"], 4, 2)), at["doc_id"], at["text"], at["lang"])
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(rows, profiles, at["text"]).where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")).drop("lang_pred", "score").toDF(*docs.columns)


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Documents are rows, told apart by where they stand in the table's files: different texts with one doc_id are judged
    each, and of equal rows, or of near copies with one doc_id, the first there stays. Null ids stay. Null, empty and
    wordless texts are copies of each other. Very long texts are compared whole. Other columns, whatever their names, come
    through. Empty table: empty. No text moves: the rows that go are marked beside the files that hold them.
    """
    folder, place = work_dir(spark), private("place", docs)
    rows = located(docs, place, folder)
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id"), f"{place}.file", f"{place}.row"))
    found = simhash.similar_documents(rows.select(key.alias("id"), "text"), "id")
    return without(rows, place, found.where("id != component").select("id.file", "id.row"), f"{folder}/gone")


@_in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents that hold a copy of a benchmark item, edited ones included (op6's threshold). Stays: the rest.

    Documents are rows, told apart by where they stand in the table's files, so that rows which share an id, or have none,
    are judged each; equal rows go or stay together. Null and empty texts stay. Very long texts are searched whole. Other
    columns come through, whatever their names. Empty table or benchmark: nothing goes. No text moves, as in near_dedup.
    """
    folder, place = work_dir(spark), private("place", docs)
    rows = located(docs, place, folder)
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), id_col=place)
    return without(rows, place, found.select("id.file", "id.row").distinct(), f"{folder}/gone")


@_in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts becomes [KIND], and n_chars, where there is one, the new length.

    Of overlapping spans the union is replaced, named by the first and longest. Null texts stay null (n_chars 0), equal
    rows change alike, very long texts are searched whole. Other columns come through, whatever their names. Empty table:
    empty.
    """
    rows, at = _numbered(docs)
    out = pii.detect(rows, at["text"]).withColumn(at["text"], F.col("redacted"))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.coalesce(F.char_length(at["text"]).cast("long"), F.lit(0).cast("long")))
    return out.select(*rows.columns).toDF(*docs.columns)


@_in_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids (little-endian unsigned 16-bit), its sequence and its place there, sequences of 2048 tokens.

    Null and empty texts are a piece of one id; null and repeated ids stay, each row is a document; long texts are cut
    into several pieces. Other columns are not read. Empty table: empty.
    """
    return packing.pack(docs, tokenizer(), room=2048, keep_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: Tokens, fingerprints and alignments are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"{i}_{name}")
    return docs
