"""A training corpus from documents, in five stages. Part of storyloom.llm, at the top so that it can be run by name.

Each stage takes the rows its predecessor kept, written as Parquet and read again. Stages need the columns
doc_id and text, use lang, source and n_chars where they are there, and keep all columns of documents, whatever
their names (dots and names that operators use themselves included). No documents give no rows anywhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontamination, langid, packing, secrets, simhash
from storyloom.llm._common import carried, cut, quoted, small_batches, table

#: A prediction must be this many times as likely as pure chance, one over the number of languages.
OVER_CHANCE = 1.2


def _with(docs: DataFrame, row: str, **changed: Column) -> list[Column]:
    """The columns of docs, taken from the struct `row` but for the changed ones."""
    return [(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters (null and empty texts too), or a score near chance.

    A missing lang is filled in. Repeated rows are judged alike and each kept; ties go to the language first
    in order. With a single language learnt every text with letters stays; with none learnt (no labelled
    rows), no text can be told and all go.
    """
    small_batches(spark)
    lang = quoted(docs, "lang") if "lang" in docs.columns else F.lit(None).cast("string")
    labelled = docs.select(quoted(docs, "text").alias("text"), lang.alias("lang"))
    model = langid.train(labelled, sample=2000, landmarks=256)
    named = langid.identify(docs.select(carried(docs, "text").alias("row"), quoted(docs, "text").alias("text")), model, with_text=True)
    least = min(1.0, OVER_CHANCE / max(1, len(model.languages)))
    kept = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    filled = {"lang": F.coalesce(F.col("row").getField("lang"), "lang_pred")} if "lang" in docs.columns else {}
    return kept.select(*_with(docs, "row", text=F.col("text"), **filled))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents with five-word shingles at least 0.8 alike.

    Null and empty texts are one text; texts of fewer than five words are alike only if their words are the
    same. Of a row that repeats, one stays; a null id comes last; of equal ids the smaller text key stays.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts hold nothing and stay; repeated rows are judged alike and each kept; without a
    benchmark all stay.
    """
    small_batches(spark)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), size=10, carry=True)
    return found.where("n_hit = 0").select(*_with(docs, "row"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, repeated rows too, with secrets replaced by a mark; n_chars follows the text.

    Null texts stay null (their n_chars as it was); a missing source or lang counts as an owner of its own.
    """
    owner, lang = (quoted(docs, c) if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang"))
    clean = secrets.redact_documents(docs, owner=owner, repository=F.concat_ws("/", owner, lang))
    if "n_chars" not in docs.columns:
        return clean
    count = F.coalesce(F.char_length(quoted(clean, "text")).cast(docs.schema["n_chars"].dataType), quoted(clean, "n_chars"))
    return clean.select(*[count.alias(c) if c == "n_chars" else quoted(clean, c) for c in clean.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids and places in sequences of 4096.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each, equal lengths in the
    order of ids. Of the documents' columns only doc_id is returned.
    """
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and the learned model are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
