"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output, each on all that is left.

Defined cases, in every stage: a null or empty text has no letter, so language ID drops it (fed to a later stage, it is
like any other empty text for near-dedup, never contaminated, taken zero times by the mixture, and one end id as tokens);
rows are told apart by themselves, not by their ids, so ids may be null or repeat; equal rows are near duplicates of each
other; an empty table stays empty; further columns, whatever they are called, are passed on until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from syntenia.llm import decontaminate, language_id, mixing, queries, simhash, store, wavelet


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without a letter, or like none of the languages, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of 0.8 or more in the similarity of 5-word shingles: the smallest id's."""
    return simhash.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, store.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards of all that is left, and what they hold of each document."""
    return wavelet.token_output(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: Language ID, fingerprints, alignment and tokens are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, held = store.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with store.scope() as spared:
            docs = store.keep(stage(spark, docs, sf_dir), name.split()[0].lower())
            spared.append(docs)
        if held is not None:
            store.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
