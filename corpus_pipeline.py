"""From raw documents to packed sequences: five stages, each applied to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import mixing, ngram_join, packing, secrets, toxicity
from loomline.llm.common import Scratch, table

#: A file of a public vocabulary, at the same place on every executor: tokens, and words that are cheap to guess.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The stage joins by five words and four fifths; ngram_join's own defaults are those of the query op4_ngram_join.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is fitted on a bounded sample of labelled rows.

    Null and empty texts score like any text without a hit, so they stay; very long texts are scored whole; repeated
    rows get one score. Without labels of both kinds, or without rows, the lexicon's fixed terms alone decide.
    """
    model = toxicity.fit(toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id.

    Null and empty texts are linked with nothing and stay, as do rows without doc_id; rows that share a doc_id are one
    document. An empty table gives an empty one.
    """
    return ngram_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced by marks, whole values however long. Null and empty texts stay as they
    are; n_chars is counted again."""
    return secrets.redact(docs, words=VOCABULARY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null and empty texts come as often as their source is
    taken whole; rows without a source are one source; rows of one doc_id are taken together."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences. Null and empty texts are one piece of one token; a document
    that the mix repeats is packed as often."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity model is learned from labels and the packing plan is iterative, so SQL can't give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, after every stage. Columns other than those of documents pass through to
    the last stage, whatever their names; an empty table gives an empty result."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return docs
