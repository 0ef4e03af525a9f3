"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token shards, each on what the last one kept.

All stages but the last return the columns of their input, whatever else it holds; rows, not ids, are kept or dropped,
so null and repeated doc_ids are allowed throughout; an empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import decontam, jaccard, mixing, quality, queries, tokens
from lattice.storage import stored


#: Units that a worker of the last stage remembers.
KNOWN_UNITS = 100_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbour vote reaches 0.3.

    Null and empty texts are scored like any other text, by the vote on a text without terms; equal texts score
    alike, so they stay or go together; without usable labels every text gets the smoothed share of good ones.
    """
    return quality.keep_good(spark, docs, quality.fit(spark, docs, queries.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at Jaccard 0.75 on five-word shingles: the smallest doc_id, a null one last.

    Rows without words (null, empty or white text) link with nothing and all stay; of rows with one id and one set of
    shingles the first by text stays; a repeated id may keep one text and lose another.
    """
    return jaccard.deduplicate(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, re-parameterised ones included.

    Null and empty texts hold no passage and stay; a leaking text goes with every row that has it, with any id or none;
    null or very short items match nothing; an empty benchmark drops nothing.
    """
    return decontam.decontaminate(spark, docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with their raked probabilities, their weights raked to the targets within the token budget.

    Null source and lang are the value ''; a text without words weighs one token; the draw is a hash of the id (of the
    text, where that is null), so repeated rows are drawn together and reruns agree.
    """
    return mixing.sample(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, read back per document: doc_id, start, n_tokens, ids_crc32.

    In ascending doc_id order, null ids first, repeated ids by text; a null or empty text is its end id alone. Workers
    remember fewer units than alone: the stages before have left the executors' heaps grown.
    """
    return tokens.read_shards(tokens.write_shards(spark, docs, queries.tokenizer_path(), known_units=KNOWN_UNITS))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: Classifier, tokenizer and 64-bit set hashes have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
