"""The corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; the last returns doc_id, lang, source, n_tokens, ids and round_trip.

Defined cases, for each stage: null, empty and blank texts are no language and go in the first stage (alone, the other
stages keep them); a very long text is read whole; of repeated rows one stays after near-dedup; a null doc_id takes part;
ties go to the smallest doc_id; an empty table gives an empty one; extra columns, whatever their names, are kept as they are
by all stages but the last, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontaminate, langid, neardup, repeats
from pulsegrid.llm._common import materialize, read_table
from pulsegrid.llm.queries import vocabulary

#: Documents whose language is less certain go.
LEAST_SCORE = 0.5
#: DuckDB can't express language ID and BPE; test_pipeline_equals_brute_force in tests/llm/test_sets.py compares all stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a certain language, which fills a null lang; those without a letter go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identified(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur before are cut; texts of which nothing is left go."""
    return repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.encode_documents(docs, vocabulary(), carry=["doc_id", "lang", "source", "text"], decode=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("repeat_cut", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
