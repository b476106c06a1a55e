"""A corpus pipeline: toxicity, quality rules, near-duplicate removal, packing.

Every stage takes what its predecessor kept. Rows with a null text count as empty texts. Rows with a
null doc_id pass the near-duplicate stage, and rows that repeat a doc_id and its text are one
document there; a doc_id on several texts is several documents. Columns beside those of documents are
carried along up to the packing, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import near_dup, packing, queries, rules, toxicity
from pagemill.llm.common import checkpoint, table


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`doc.{c}`").alias(c) for c in names))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", mod=5, held_out=0)
    return _columns(toxicity.score(docs, model, docs.columns, keep_spans=False).filter("score < 0.5"), docs.columns)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return _columns(rules.judge(docs, docs.columns).filter("kept"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the least by doc_id and then by its text's hash."""
    return near_dup.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, queries.BPE, end_id=2, length=1024)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_by_rules), ("near duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
