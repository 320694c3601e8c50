"""The training-data pipeline: STAGES applied in turn to the documents, each written as Parquet and read by the next.

All stages but the last return the columns of documents.  A document taken more than once by the mix stands as often in its result.

Defined cases, for every stage: a null text counts as empty and stays what it is unless the stage changes texts; rows without an id take part (as one document in
line dedup, where ids decide who keeps a line); repeated rows are copies of each other; a null source is a source of its own; an empty table
gives an empty result with the stage's columns; further columns pass through, whatever their names, but for the last stage's result.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import pressdelta
from pressdelta.llm import linededup, mixing, neardup, quality, queries, subwords
from pressdelta.llm.common import store
from pressdelta.session import pin_session

# Python workers may start in another folder
cloudpickle.register_pickle_by_value(pressdelta)

KEEP_FROM = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts.  Its labels are the corpus's own, but for those held out."""
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id"))))
    return docs.filter(quality.score(model, F.col("text")) >= KEEP_FROM)


def drop_seen_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; a document all of whose lines are gone is empty and stays."""
    done = linededup.dedup_lines(docs)
    return done.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return neardup.first_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes it."""
    rows = store(docs.select("doc_id", F.array("source").alias("sources"), mixing.size_of("text").alias("size")), "mix-docs")
    mix = mixing.plan_mix(spark, rows, mixing.weight_of, doc_id="doc_id")
    taken = mix.copies(docs, F.col("doc_id"), F.array("source"), "__copies")
    return taken.withColumn("__copy", F.explode("__copies")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of the text decoded from them: doc_id, source, n_tokens, ids, decoded_sha256."""
    # less is cached than where the operator runs by itself: the workers have served the stages before
    done = subwords.encoded(docs.select("doc_id", "source", "text"), queries.tokenizer("piece_bpe_32k.model"), decoded="decoded", cached=100_000, slice_bytes=1 << 20)
    return done.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", keep_good), ("line dedup", drop_seen_lines), ("near-dedup", drop_near_copies), ("mixing", mix_sources), ("subword encoding and decoding", encode_pieces)]
# neither the classifier nor near-duplicates nor the vocabulary can be said in SQL: tests/llm/test_pipeline.py holds the stages against plain code
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_session(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
