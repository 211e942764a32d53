"""Training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``:

1. toxicity: documents whose score reaches 0.3 go (fitted on the rows not held out);
2. near_dedup: one document (the smallest id) of each near-duplicate group stays
   (five-word shingles, similarity 0.8 or more);
3. substring_dedup: words covered by a 20-word window that also starts earlier go;
4. decontamination: the merged spans of benchmark phrases go;
5. sentencepiece: token ids are added (``n_tokens``, ``piece_ids``), after decoding them
   again and comparing with the text.

SQL cannot express stages 1, 3 and 5; they are tested against brute force.

Defined results, for every stage: a null text counts as empty and stays null where the stage
changes nothing; rows with a null id are documents of their own and never count as copies of
another document by their id; repeated rows are kept or dropped together; an empty table gives an
empty table with the same columns; columns beside ``doc_id`` and ``text`` pass through under
their own names, whatever these are (the last stage replaces input columns named like those it
adds). Ties between copies go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, minhash, pieces, substring, tokens, toxicity
from threadlens.llm.common import sealed


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches 0.3 go; a null or empty text is scored as such and
    stays. The model is fitted on the labelled rows of ``docs`` that are not held out; without
    any, nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit_default(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows of the smallest id stay; documents without
    words, and rows without an id, are in no group."""
    return minhash.keep_first(docs, shingle=5, percent=80, bands=32)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated 20-word window covers go (its first place in id order stays);
    texts that lose nothing are unchanged, to the byte."""
    # whole rows travel with the blocks here, after stages whose workers are still there
    return substring.drop_repeats(docs, block_bytes=3_000_000)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The merged spans of benchmark phrases go; texts without one are unchanged."""
    return decontaminate.remove_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``n_tokens``, ``piece_ids`` and ``round_trip`` (the decoded ids are the text); a null
    text has the begin and end ids. Input columns of these three names are replaced."""
    added = ("n_tokens", "piece_ids", "round_trip")
    inner, restore = sealed(docs, own=("text",))
    encoded = pieces.encode_texts(inner, pieces.default_model())
    # a space mark in the text decodes as a space
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return restore(encoded.select(*inner.columns, F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids",
                                  same.alias("round_trip")), added)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    folder = tokens.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
