"""The corpus pipeline: stages over documents, each an operator of ``postmill.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
All but the last return the columns of ``documents`` and no others, so an added column cannot
clash with one that a stage makes. A null, empty or letterless text is
rejected by the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import language
from postmill.llm.bindings import tokenizer
from postmill.llm.common import Scratch, collected, held_out
from postmill.llm.line_chunks import remove_repeated_chunks
from postmill.llm.packing import pack_documents
from postmill.llm.simhash import near_duplicates
from postmill.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _cleaned(kept: DataFrame, removed: Column) -> DataFrame:
    """The columns of documents with shortened texts; emptied ones go."""
    text = F.when(removed > 0, F.col("kept_text")).otherwise(F.col("text"))
    return (
        kept.filter((removed == 0) | (F.trim("kept_text") != ""))
        .withColumns({"text": text, "n_chars": F.when(removed > 0, F.char_length("kept_text"))
                      .otherwise(F.col("n_chars"))})
        .select(*COLUMNS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; a missing language is filled in, however sure the answer.

    All texts go if no language was learned.
    """
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))), tokenizer("piece_bpe_32k.model"))
    named = language.predict(docs, model, keep=COLUMNS)
    return (
        named.filter(F.col("lang_pred") != language.UNKNOWN)
        .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; so do documents that consist of them."""
    return _cleaned(remove_repeated_chunks(docs.select(*COLUMNS)), F.col("n_removed"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays: the smallest id, null ids last.

    Rows are judged one by one. Of rows that repeat the smallest id, or are all without one,
    that with the smallest hash of its values stays, and of equal rows one.
    """
    marks = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)),
             "own": F.xxhash64(*COLUMNS), "again": F.xxhash64(F.lit(1), *COLUMNS)}
    rows = docs.select(*COLUMNS).withColumns(marks)
    keyed = rows.select(F.struct(*marks).alias("row"), "text")
    spare = near_duplicates(keyed, key="row", width=3, radius=2).filter("row > component_id")
    # The list of rows grows with the corpus: one plan for every size. Equal rows meet in it.
    return (
        rows.join(spare.select("row.*").hint("merge"), list(marks), "left_anti")
        .dropDuplicates(list(marks)).select(*COLUMNS))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller id has too go; emptied documents as well."""
    return _cleaned(remove_repeats(docs.select(*COLUMNS)), F.col("n_removed"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer(), size=2048)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("substring_dedup", dedup_passages),
    ("best_fit_packing", pack),
]

#: Fingerprints, language scores and token ids are no SQL; tests/llm holds each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again.

    What the stages put down goes with them; only the last result stays, for the caller.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES:
        with collected():
            docs, path = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [path]
    return docs
