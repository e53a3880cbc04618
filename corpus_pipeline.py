"""A corpus pipeline of four stages: toxic documents go, near duplicates go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame, which is written and read
again as the docs of the next.  All but the last return the columns of documents.

Cases: rows without an id stay rows of their own; rows that repeat an id are judged one by one; null and empty texts are
no toxic ones and near no other, so they stay until the mix, which takes them while their leaf has budget left, and
encode to no ids; very long texts are taken whole; other columns are dropped; an empty table goes through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import bpe_codec, jaccard_join, queries, toxicity
from tallyward.plans.lineage import free, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Ids and text digests (24 bytes each) of dropped documents that are sent to all tasks at most; with more, texts are shuffled instead.
BROADCAST_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels of those it may learn from."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.toxicity_scores(docs, model, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one: that with the least id (null last), and of those the least digest of a text."""
    key = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    rows = written(jaccard_join.jaccard_rows(docs, {"text_key": key}).groupBy("doc_id", "text_key", "part").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    least = rows.groupBy("part").agg(F.min(order).alias("least"))
    marked = rows.join(least, "part").select("doc_id", "text_key", (order == F.col("least")).alias("kept"), "copies").filter("not kept or copies > 1")
    told = written(marked)
    free(rows)
    # What goes, and what is kept but once though it occurs several times.
    marks = told.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "kept")
    few = told.count() <= BROADCAST_IDS
    keyed = docs.select(*COLUMNS, key.alias("text_key"))
    same = lambda m: keyed.doc_id.eqNullSafe(m.id_) & (keyed.text_key == m.key_)
    single = keyed.join(F.broadcast(marks) if few else marks, same(marks), "left_anti").select(*COLUMNS)
    repeated = marks.filter("kept")
    if not told.filter("kept").limit(1).count():
        return single
    again = keyed.join(F.broadcast(repeated) if few else repeated, same(repeated), "left_semi")
    return single.unionByName(again.groupBy("doc_id", "text_key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each epoch that takes them."""
    return queries.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row."""
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("mixing", mix_sources), ("bpe encoding", encode)]

#: Token ids and learned scores are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            free(before)
    return docs
