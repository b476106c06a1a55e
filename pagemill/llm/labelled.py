"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import fold


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, limit: int) -> DataFrame:
    """doc_id, text and y of at most `limit` labelled documents outside the held-out fold: those with
    the least hashes of their ids. A doc_id counts once, with the least of its texts, and so does a
    text, with the least of its doc_ids. Rows without a label or doc_id don't count."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), mod) != held_out))
    own = own.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)  # at most `limit` small rows: bounded, so broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(own), rows["doc_id"] == own["label_id"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    least = F.min(F.struct("doc_id", "text", "y")).alias("r")
    return rows.groupBy(F.xxhash64("text").alias("same")).agg(least).select("r.doc_id", "r.text", "r.y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, shapes: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = shapes, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in shapes.items()}
        self.v = {k: np.zeros_like(v) for k, v in shapes.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
