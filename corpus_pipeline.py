"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Its result is
written as Parquet and read again as the next one's documents; when a stage is called, what the one before
needed is freed. Null and empty texts go in the first stage, as they have no language; the others keep them.
Null ids are kept like others, repeated rows and ids are rows of their own except to near_dedup, other columns
are left out, and an empty table gives an empty table.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.llm import decontamination, language_id, near_dedup, packing, suffix_dedup
from tuplewise.llm._common import documents, marks, materialise, release, taken

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_left: list = []


def stage(f):
    """Frees the scratch tables and broadcasts of the stage before, whose result is written by the time ``f`` is called."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            release(_left.pop())
        since = marks()
        try:
            return f(spark, docs, sf_dir)
        finally:
            _left.append(taken(since))

    return run_stage


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), how).select(*COLUMNS)


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letters, or no language that is likely enough.

    It learns from ``lang`` where that is given. If no row has one, there is no language to reject a document for,
    and only documents without letters go. Two equal texts are judged alike.
    """
    model = language_id.fit(docs)
    found = language_id.identify(docs, model)
    rejected = F.col("lang_rejected") if model.languages else ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(~rejected).select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near duplicates: five-word shingles, 0.8.

    Rows that repeat an id and a text are one document.
    """
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    kept = _by_id(docs, found.where("kept"), "left_semi")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


@stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that recur anywhere from the texts; characters that a cut left in part go too.

    Every document stays, also without any text left; null texts stay null.
    """
    out = suffix_dedup.remove_repeats(docs.withColumn("_null", F.col("text").isNull()), carry=("doc_id", "lang", "source", "_null"))
    rest = F.expr("make_valid_utf8(cast(kept as string))")
    text = F.when(~F.col("_null"), F.when(F.col("n_removed") == 0, rest).otherwise(F.replace(rest, F.lit("\ufffd"), F.lit(""))))
    return out.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item: all rows of an id of which a text does. Without items, none go."""
    return _by_id(docs, decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti")


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: one row per piece of a document. A document without text is one id, its end."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path(packing.TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Learnt models, registers and a random sketch are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, f in STAGES:
        docs = materialise(f(spark, docs, sf_dir), f"stage-{name}")
    return docs
